"""Stored search indexes.

An index is a set of Parquet tables partitioned by part: the first part is written
whole, each batch added later is one more. A part is read once the index's log names
it. Statistics are kept as increments: a part brings its own counts, less those of the
documents it replaces, and reading adds them up. When there are more than ``MAX_PARTS``
parts, the next batch makes one of all.
"""

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwise.operators.blocks import BLOCKS, block_field_stats, block_postings, block_stats, places_of, postings_from
from leafwise.operators.indexing import (
    by_field,
    document_terms,
    embed_documents,
    field_terms,
    postings_of,
    term_stats,
)
from leafwise.operators.matching import term_signatures
from leafwise.operators.scoring import term_bucket
from leafwise.plans.joins import fits_broadcast, join_small
from leafwise.plans.staging import stage

# Tasks that share the writing of one index partition, so that the posting list of
# a frequent term is not one task's work.
WRITERS_PER_BUCKET = 4
MAX_PARTS = 16
LOG = "part int, first int, buckets int"
STORED_BLOCKS = BLOCKS.replace("ids array<string>, lengths array<int>, ", "") + ", bucket int, part int"
# Bits of a shard's number below those of the part it belongs to.
PART_SHIFT = 52


@dataclass
class Index:
    """The tables a search reads. ``buckets`` is set when they are stored by bucket.

    ``places`` numbers the documents by shard, ``dead`` those places whose document a
    later part replaces; see ``operators.blocks``.
    """

    documents: DataFrame
    blocks: DataFrame
    places: DataFrame
    term_stats: DataFrame
    field_stats: DataFrame
    vectors: DataFrame
    postings: DataFrame
    signatures: DataFrame | None = None
    dead: DataFrame | None = None
    buckets: int | None = None


def build_index(documents: DataFrame, encoder, vectors: DataFrame | None = None) -> Index:
    """Index tables of a document table that is cheap to read again.

    Texts are tokenised once: the term counts per document are staged, and postings and
    blocks are read from them. Statistics come from the blocks.
    """
    terms = stage(document_terms(documents), "document_terms", compression="zstd")
    if vectors is None:
        vectors = stage(embed_documents(documents, encoder, terms), "vectors", compression="zstd")
    blocks = stage(block_postings(terms), "blocks", compression="zstd")
    fields = block_field_stats(blocks).select("field", "n_docs", (F.col("tokens") / F.col("n_docs")).alias("avgdl"))
    return Index(
        documents=documents,
        blocks=blocks,
        places=places_of(blocks),
        postings=postings_of(by_field(terms)),
        term_stats=stage(block_stats(blocks), "term_stats", compression="zstd"),
        field_stats=stage(fields, "field_stats"),
        vectors=vectors,
    )


def _log(spark: SparkSession, path: str):
    """The newest part, the first of those that belong to it, and the number of buckets; null without an index."""
    try:
        rows = spark.read.schema(LOG).parquet(f"{path}/log").collect()
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return None
    return max((r["part"], r["first"], r["buckets"]) for r in rows) if rows else None


def _less(terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the statistics lose: documents per term, documents and tokens per field."""
    words = term_stats(postings_of(terms)).withColumn("df", -F.col("df"))
    fields = terms.groupBy("field").agg((-F.count(F.lit(1))).alias("n_docs"), (-F.sum("dl")).alias("tokens"))
    return words, fields


def _write_part(documents: DataFrame, path: str, part: int, first: int, encoder, buckets: int, gone: DataFrame | None = None) -> None:
    """Write the tables of a part, then name it in the log. ``gone``: documents it replaces, with their ``part``."""
    spark = documents.sparkSession

    def write(rows: DataFrame, table: str, *partitions: str) -> None:
        # the same part again, left over from a lost job, is replaced
        rows = rows.withColumn("part", F.lit(part))
        rows.write.mode("overwrite").options(partitionOverwriteMode="dynamic", compression="zstd").partitionBy("part", *partitions).parquet(f"{path}/{table}")

    spread = F.pmod(F.xxhash64(F.col("shard")), F.lit(WRITERS_PER_BUCKET))
    terms = stage(document_terms(documents), "document_terms", compression="zstd")
    blocks = stage(block_postings(terms), "blocks", compression="zstd").withColumn("bucket", term_bucket(F.col("term"), buckets))
    listed = F.col("ids").isNotNull()
    write(blocks.filter(listed).select("shard", "ids", "lengths"), "shards")
    lists = blocks.filter(~listed).drop("ids", "lengths").repartition("field", "bucket", spread).sortWithinPartitions("field", "bucket", "term")
    write(lists, "blocks", "field", "bucket")
    stored = documents.withColumn("bucket", term_bucket(F.col("id"), buckets))
    stored = stored.repartition("bucket", F.pmod(F.hash(F.col("id")), F.lit(WRITERS_PER_BUCKET))).sortWithinPartitions("bucket", "id")
    write(stored, "documents", "bucket")
    write(embed_documents(documents, encoder, terms), "vectors")
    write(term_signatures(blocks.filter(~listed)), "signatures")
    words, fields = block_stats(blocks), block_field_stats(blocks)
    if gone is not None:
        less_words, less_fields = _less(field_terms(gone))
        words = words.unionByName(less_words).groupBy("field", "term").agg(F.sum("df").alias("df")).filter("df <> 0")
        fields = fields.unionByName(less_fields)
        write(gone.select("id", F.col("part").alias("of")), "replaced")
    write(words, "term_counts")
    write(fields.coalesce(1), "field_counts")
    spark.createDataFrame([(part, first, buckets)], LOG).coalesce(1).write.mode("append").parquet(f"{path}/log")


def write_index(documents: DataFrame, path: str, encoder, buckets: int = 64) -> None:
    """Store the index tables below ``path`` as one part, which takes the place of all before.

    Blocks of postings lie in folders by field and hash of the term, documents by hash
    of the id. A search joins on the bucket as well, so that only the folders with its
    terms and its page are read. ``WRITERS_PER_BUCKET`` tasks share each bucket. The
    log names the part last; until then the parts before are read.
    """
    log = _log(documents.sparkSession, path)
    part = 1 + (log[0] if log else 0)
    _write_part(stage(documents, "indexed_documents", compression="zstd"), path, part, part, encoder, buckets)


def add_to_index(documents: DataFrame, path: str, encoder) -> None:
    """Make a batch of documents (one row per id) searchable; ids that are there already are replaced.

    The batch becomes one more part, with the ids it replaces in earlier parts; no
    earlier file is read for that but the documents of those ids. The same batch again
    changes nothing that a search sees. One writer at a time adds to an index; a
    missing one is created.
    """
    spark = documents.sparkSession
    documents = stage(documents, "indexed_documents", compression="zstd")
    if documents.isEmpty():
        return
    log = _log(spark, path)
    if log is None:
        return write_index(documents, path, encoder)
    part, first, buckets = log
    alive = _alive(spark, path, "documents", log)
    ids = documents.select("id", term_bucket(F.col("id"), buckets).alias("bucket"))
    if part - first + 1 >= MAX_PARTS:
        kept = alive.join(ids.select("id"), "id", "left_anti").select(*documents.columns)
        return write_index(kept.unionByName(documents), path, encoder, buckets)
    gone = stage(join_small(alive, ids, ["id", "bucket"]), "replaced_documents", compression="zstd")
    _write_part(documents, path, part + 1, first, encoder, buckets, None if gone.isEmpty() else gone)


def _stored(spark: SparkSession, path: str, table: str, log, schema: str | None = None) -> DataFrame:
    """The rows of a table in the parts that are read."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{path}/{table}").filter(F.col("part").between(log[1], log[0]))


def _replaced(spark: SparkSession, path: str, log) -> DataFrame | None:
    """``(id, part)``: documents of parts that a later part replaces."""
    try:
        rows = _stored(spark, path, "replaced", log, "id string, of int, part int")
        return rows.select("id", F.col("of").alias("part")).distinct()
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return None


def _without(rows: DataFrame, gone: DataFrame | None, key: str) -> DataFrame:
    if gone is None:
        return rows
    gone = gone.withColumnRenamed("id", key)
    return rows.join(F.broadcast(gone) if fits_broadcast(gone) else gone, [key, "part"], "left_anti")


def _alive(spark: SparkSession, path: str, table: str, log) -> DataFrame:
    return _without(_stored(spark, path, table, log), _replaced(spark, path, log), "id")


def read_index(spark: SparkSession, path: str) -> Index:
    """The index as its log has it, with the number of buckets it was written with."""
    log = _log(spark, path)
    if log is None:
        raise FileNotFoundError(path)
    shard = F.col("shard") + F.shiftleft(F.col("part").cast("long"), PART_SHIFT)
    blocks = _stored(spark, path, "blocks", log, STORED_BLOCKS).withColumn("shard", shard)
    shards = _stored(spark, path, "shards", log, "shard long, ids array<string>, lengths array<int>, part int").withColumn("shard", shard)
    gone = _replaced(spark, path, log)
    every = places_of(shards).withColumn("part", F.shiftright("shard", PART_SHIFT).cast("int"))
    places = _without(every, gone, "doc_id").drop("part")
    dead = None
    if gone is not None:
        dead = join_small(every, gone.withColumnRenamed("id", "doc_id"), ["doc_id", "part"], salt_by="ord").select("shard", "ord")
    words = _stored(spark, path, "term_counts", log, "field string, term string, df long, part int")
    if log[0] > log[1]:
        words = words.groupBy("field", "term").agg(F.sum("df").alias("df")).filter("df > 0")
    fields = _stored(spark, path, "field_counts", log, "field string, n_docs long, tokens long, part int")
    fields = fields.groupBy("field").agg(F.sum("n_docs").alias("n_docs"), F.sum("tokens").alias("tokens")).filter("n_docs > 0")
    blocks = blocks.drop("part").unionByName(shards.drop("part"), allowMissingColumns=True)
    return Index(
        documents=_alive(spark, path, "documents", log).drop("part"),
        blocks=blocks,
        places=places,
        term_stats=words.select("field", "term", "df"),
        field_stats=fields.select("field", "n_docs", (F.col("tokens") / F.col("n_docs")).alias("avgdl")),
        vectors=_alive(spark, path, "vectors", log).drop("part"),
        postings=postings_from(blocks, places),
        # a term may be in several parts; its pairs are made distinct, whichever part they come from
        signatures=_stored(spark, path, "signatures", log, "sig long, expansion string, expansion_parity long, part int").drop("part"),
        dead=dead,
        buckets=log[2],
    )
