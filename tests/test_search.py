import math

import pytest
from pyspark.sql import functions as F

from leafwise.functions.encoders import hash_encoder, model_encoder
from leafwise.functions.text import tokenize
from leafwise.operators import indexing, matching, ranking, scoring
from leafwise.operators.exporting import present_results
from leafwise.operators.parsing import parse_documents
from leafwise.plans import search as s
from leafwise.plans.staging import stage
from leafwise.plans.summaries import summarize
from leafwise.sources import tables
from workload import inputs
from tests.conftest import SMALLEST

ENCODER = hash_encoder(16)
TEXTS = {
    "/d/pipe.txt": "CORROSION GUIDE\nBackground of pipe corrosion. Don't panic! Corrosion grows.\nSCOPE\nscope of pipes",
    "/d/valve.txt": "VALVE MANUAL\nValves and seals, no rust here.",
    "/d/weld.pdf": "welding notes about corosion and pipe welds",
    "/d/empty.txt": "",
    "/d/what.xyz": "corrosion",
}


@pytest.fixture(scope="module")
def documents(spark):
    files = spark.createDataFrame(list(TEXTS.items()), "file_path string, text string")
    return stage(parse_documents(files, "2024-01-01 00:00:00"), "documents")


@pytest.fixture(scope="module")
def index(documents):
    return tables.build_index(documents, ENCODER)


def ask(spark, *rows):
    return spark.createDataFrame([(i, q) for i, q in enumerate(rows)], "query_id long, query string")


def test_parse(documents):
    rows = {r["id"]: r for r in documents.collect()}
    assert set(rows) == {"pipe", "valve", "weld"}
    assert rows["pipe"]["title"] == "CORROSION GUIDE" and rows["weld"]["title"] == "weld.pdf"
    assert rows["pipe"]["background"].startswith("Background of pipe") and rows["weld"]["scope"] is None
    assert rows["pipe"]["created_at"].year == 2024 and rows["pipe"]["category"] is None


def test_content_is_cut(spark):
    files = spark.createDataFrame([("/a/long.txt", "A" * 10000)], "file_path string, text string")
    assert len(parse_documents(files).first()["content"]) == 10000
    assert len(parse_documents(files, content_chars=5000).first()["content"]) == 5000


def test_scores_by_hand(spark, index):
    asked = matching.with_defaults(ask(spark, "valves valves"))
    expansions = matching.exact_terms(matching.query_terms(asked), index.term_stats)
    rows = scoring.bm25_score(expansions, index.postings, index.field_stats).collect()
    lengths = [len(r[0]) for r in index.documents.select(tokenize(F.col("content"))).collect()]
    own = index.documents.filter("id = 'valve'").select(F.size(tokenize(F.col("content")))).first()[0]
    mean = sum(lengths) / len(lengths)
    expected = 2 * math.log(1 + (3 - 1 + 0.5) / 1.5) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * own / mean))
    assert [(r["field"], r["doc_id"]) for r in rows] == [("content", "valve")]
    assert rows[0]["score"] == pytest.approx(expected)


def test_misspelt_words_are_found(spark, index):
    found = s.search_documents(ask(spark, "corrosoin"), index, ENCODER, knn=False).collect()
    assert {r["id"] for r in found} == {"pipe", "weld"}
    assert all("<mark>" in r["snippet"] for r in found)


def test_result_columns(spark, index):
    found = s.search_documents(ask(spark, "corrosion pipes"), index, ENCODER).filter("rank = 1")
    # A collected map is a dict in no particular order; the column keeps it.
    row = found.withColumn("fields", F.map_keys("highlights")).first()
    assert row["id"] == "pipe" and row["download_url"] == "/documents/pipe/download"
    assert row["fields"] == ["title", "headings", "background", "scope", "content"]
    assert row["highlights"]["title"] == ["<mark>CORROSION</mark> GUIDE"]
    assert row["snippet"] == row["highlights"]["title"][0]
    assert (row["total"], row["page"], row["page_size"]) == (3, 1, 20)


def test_blank_query_gives_everything(spark, index):
    rows = s.search_documents(ask(spark, "  \n"), index, ENCODER).orderBy("rank").collect()
    assert [(r["id"], r["score"], r["total"]) for r in rows] == [("pipe", 1.0, 3), ("valve", 1.0, 3), ("weld", 1.0, 3)]
    assert rows[0]["highlights"] == {} and rows[0]["snippet"].startswith("Background")
    matched = scoring.match_all(matching.with_defaults(ask(spark, " ", "x", "")), index.documents)
    assert matched.count() == 6


def test_keyword_wins_over_query(spark, index):
    schema = "query_id long, query string, keyword string, search_fields array<string>"
    asked = spark.createDataFrame([(7, "valve", "welds", ["content"]), (8, "", "", None)], schema)
    found = s.search_documents(asked, index, ENCODER, fuzzy=False, knn=False).collect()
    assert [(r["query_id"], r["id"]) for r in found if r["query_id"] == 7] == [(7, "weld")]
    assert len([r for r in found if r["query_id"] == 8]) == 3


def test_query_without_hits(spark, index):
    asked = matching.with_defaults(ask(spark, "zzzzzzzzzz"))
    terms = matching.query_terms(asked)
    pages, totals = s.search_pages(asked, index, ENCODER, terms, s.expand(terms, index), knn=False)
    assert pages.count() == 0 and totals.first()["total"] == 0


def test_pages_partition_the_ranking(spark):
    scores = spark.createDataFrame([(1, f"d{i:03}", float(i % 7)) for i in range(95)], "query_id long, doc_id string, score double")
    order = sorted(range(95), key=lambda i: (-(i % 7), f"d{i:03}"))
    seen = []
    for page in range(1, 9):
        asked = spark.createDataFrame([(1, page, 15)], "query_id long, page int, page_size int")
        rows = ranking.rank_and_page(scores, matching.with_defaults(asked)).orderBy("rank").collect()
        assert [r["rank"] for r in rows] == list(range((page - 1) * 15 + 1, min(page * 15, 95) + 1))
        seen += [r["doc_id"] for r in rows]
    assert seen == [f"d{i:03}" for i in order]


def test_limit_cuts_a_page(spark):
    asked = spark.createDataFrame([(1, 20, 5)], "query_id long, page_size int, limit int")
    scores = spark.createDataFrame([(1, f"{i}", 1.0) for i in range(9)], "query_id long, doc_id string, score double")
    assert ranking.rank_and_page(scores, matching.with_defaults(asked)).count() == 5


def test_fusing_is_commutative(spark):
    schema = "query_id long, doc_id string, score double"
    a = spark.createDataFrame([(1, "x", 2.0), (1, "y", 1.0)], schema)
    b = spark.createDataFrame([(1, "y", 0.5), (2, "x", 0.25)], schema)
    one = sorted(map(tuple, scoring.hybrid_fuse(a, b).collect()))
    assert one == sorted(map(tuple, scoring.hybrid_fuse(b, a).collect()))
    assert one == [(1, "x", 2.0), (1, "y", 1.5), (2, "x", 0.25)]


def test_stored_index_gives_the_same(spark, tmp_path_factory):
    documents = stage(inputs.parsed(spark, SMALLEST), "documents")
    path = str(tmp_path_factory.mktemp("index"))
    tables.write_index(documents, path, ENCODER, buckets=5)
    stored = tables.read_index(spark, path)
    fresh = tables.build_index(documents, ENCODER)
    asked = inputs.queries(spark, SMALLEST)
    keys = ["query_id", "rank", "id", "snippet", "total"]

    def rows(index):
        found = s.search_documents(asked, index, ENCODER)
        return sorted(map(tuple, found.select(*keys, F.round("score", 6)).collect()))

    assert rows(stored) == rows(fresh)


def test_headings_only_field_statistics(spark, index):
    rows = {r["field"]: r for r in indexing.field_stats(index.postings).collect()}
    assert rows["headings"]["n_docs"] == 2 and rows["content"]["n_docs"] == 3
    assert {f: (r["n_docs"], r["avgdl"]) for f, r in rows.items()} == {
        r["field"]: (r["n_docs"], r["avgdl"]) for r in index.field_stats.collect()
    }


def test_model_encoder(spark, index):
    def load():
        import numpy as np

        return lambda texts: np.array([[len(x), 1.0] for x in texts], dtype=np.float32)

    encoder = model_encoder(load)
    rows = indexing.embed_documents(index.documents, encoder).collect()
    assert len(rows) == 3 and all(len(r["embedding"]) == 2 for r in rows)
    assert s.search_documents(ask(spark, "pipe"), tables.build_index(index.documents, encoder), encoder).count() == 3


def test_presentation(spark, index):
    found = s.search_documents(ask(spark, "weld"), index, ENCODER, knn=False)
    row = present_results(found).first()
    assert row["type"] == "PDF" and row["file_name"] == "weld.pdf" and row["found"] == "Found 1 document"
    assert row["relevance"] == f"{found.first()['score']:.2f}"


def test_summaries(spark, index):
    rows = {r["query_id"]: r["summary"] for r in summarize(ask(spark, "pipe corrosion", "zz"), index, ENCODER).collect()}
    assert rows[0].startswith("Based on the search results") and "\n- " in rows[0] and rows[0].endswith(".\n")
