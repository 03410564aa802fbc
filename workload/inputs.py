"""Inputs derived from the test tables, stated once as SQL for both engines."""

from pyspark.sql import DataFrame, SparkSession

from leafwise.functions.encoders import hash_encoder
from leafwise.operators.parsing import parse_documents
from leafwise.plans.staging import spread, stage
from leafwise.sources.corpus import read_table
from leafwise.sources.tables import Index, build_index

# Every document becomes a report with one of four shapes, so that each branch of
# the parser is met: heading lines, numbered headings, keywords inside the text and
# no section at all. Further rows have an unsupported type or an empty text.
REPORTS = """
SELECT doc_id, source || '-' || doc_id AS id,
       '/corpus/' || source || '/' || source || '-' || doc_id ||
         CASE WHEN doc_id % 10 = 6 THEN '.DOCX' WHEN doc_id % 5 = 1 THEN '.docx'
              WHEN doc_id % 5 = 2 THEN '.txt' ELSE '.pdf' END AS file_path,
       CASE WHEN doc_id % 5 = 0 THEN upper(source) || ' REPORT ' || doc_id || chr(10) || chr(10) ||
                 '1. BACKGROUND' || chr(10) || text || chr(10) || chr(10) ||
                 'SCOPE OF WORK' || chr(10) || text || chr(10) ||
                 'TIMELINE AND COST' || chr(10) || text
            WHEN doc_id % 5 = 1 THEN '2.1. Introduction' || chr(10) || text || chr(10) ||
                 'FINDINGS MADE' || chr(10) || 'end'
            WHEN doc_id % 5 = 2 THEN text || ' an overview of the objectives ' || text
            ELSE text END AS text
FROM documents
UNION ALL
SELECT doc_id, source || '-' || doc_id || 'x', '/corpus/' || source || '/' || source || '-' || doc_id || 'x.xyz', text
FROM documents WHERE doc_id % 5 = 4
UNION ALL
SELECT doc_id, source || '-' || doc_id || 'e', '/corpus/' || source || '/' || source || '-' || doc_id || 'e.pdf', ''
FROM documents WHERE doc_id % 20 = 13
"""

# Every benchmark text is a query, whole.
QUERIES = "SELECT item_id AS query_id, text AS query FROM benchmark"

# The same with other pages, fields and keywords, and with each text blanked once.
PAGED_QUERIES = """
SELECT item_id AS query_id,
       CASE WHEN item_id % 4 = 3 THEN '' ELSE text END AS query,
       CASE WHEN item_id % 4 = 3 THEN text ELSE '' END AS keyword,
       CASE WHEN item_id % 4 = 1 THEN array('content', 'background')
            WHEN item_id % 4 = 2 THEN array('scope', 'title', 'headings')
            ELSE array('title', 'headings', 'background', 'scope', 'content') END AS search_fields,
       CAST(1 + item_id % 3 AS INT) AS page, 15 AS page_size, 20 AS `limit`
FROM benchmark
UNION ALL
SELECT -1 - item_id, '  ', '', array('title'), CAST(1 + item_id % 3 AS INT), 15, 10 FROM benchmark
"""

# Each document is asked for in one of four ways: by id, by file name, by a longer
# text around its id, and by a piece of its id.
REQUESTS = """
SELECT doc_id AS ord,
       CASE WHEN doc_id % 4 = 0 THEN source || '-' || doc_id
            WHEN doc_id % 4 = 1 THEN source || '-' || doc_id || '.pdf'
            WHEN doc_id % 4 = 2 THEN 'x-' || source || '-' || doc_id || '-y'
            ELSE substr(source, 3) || '-' || doc_id END AS doc_id
FROM documents
"""

# Documents to export: every report in corpus order, once by its id and once more
# under a name that only some have.
EXPORTS = """
SELECT 2 * doc_id AS ord, source || '-' || doc_id AS doc_id FROM documents
UNION ALL
SELECT 2 * doc_id + 1, 'src0-' || doc_id FROM documents
"""

ENCODER = hash_encoder()


def from_sql(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """Run ``sql`` over the test tables it names."""
    tables = {name: read_table(spark, folder, name) for name in ("documents", "benchmark")}
    for name in tables:
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}")
    return spark.sql(sql, **tables)


def reports(spark, folder):
    return spread(from_sql(spark, folder, REPORTS).select("id", "file_path", "text"))


def parsed(spark, folder):
    return parse_documents(reports(spark, folder))


def queries(spark, folder):
    return from_sql(spark, folder, QUERIES)


def paged_queries(spark, folder):
    return from_sql(spark, folder, PAGED_QUERIES)


_indexes: dict[tuple[str, str], Index] = {}


def index(spark, folder) -> Index:
    """The search index of the reports, built once per session and folder."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _indexes:
        _indexes[key] = build_index(stage(parsed(spark, folder), "documents", compression="zstd"), ENCODER)
    return _indexes[key]
