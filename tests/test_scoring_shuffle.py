import pytest
from pyspark.sql import functions as F

from leafwise.operators import blocks as b
from leafwise.operators import scoring
from leafwise.plans import joins
from leafwise.plans.staging import stage

FIELD_STATS = [("content", 2, 2.0)]


@pytest.fixture(scope="module")
def tables(spark):
    """Two documents of one word each, for which forty query words stand."""
    postings = spark.createDataFrame([("content", "w", "a", 1, 2), ("content", "w", "b", 2, 2)], "field string, term string, doc_id string, tf long, dl long")
    rows = [("content", f"q{i}", i, "w", 1 / (i + 1), 2, 2) for i in range(40)]
    expanded = spark.createDataFrame(rows, "field string, term string, term_id long, expansion string, weight double, df long, df_max long")
    stats = spark.createDataFrame(FIELD_STATS, "field string, n_docs long, avgdl double")
    return postings, stage(expanded, "expanded"), stats


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("at_once", [4_000_000, 4])
def test_a_posting_is_shuffled_once_for_all_words(tables, monkeypatch, broadcast, at_once):
    postings, expanded, stats = tables
    monkeypatch.setattr(scoring, "SCORES_AT_ONCE", at_once)
    for module in (joins, scoring):
        monkeypatch.setattr(module, "fits_broadcast", lambda *a, **k: broadcast)
    found = scoring.posting_scores(scoring.with_factor(expanded, stats), postings)
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Generate explode") < text.index("Repartition")  # the plan is read from its end
    scores = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("score").alias("best"), F.min("score").alias("least")).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["n"]) for r in scores] == [("a", 40), ("b", 40)]
    assert all(r["best"] == pytest.approx(40 * r["least"]) for r in scores)


def test_shards_score_a_few_postings_at_a_time(spark, tables, monkeypatch):
    _, expanded, stats = tables
    documents = spark.createDataFrame([("a", "w"), ("b", "w w w x"), ("c", "y")], "id string, content string")
    for field in ("title", "background", "scope"):
        documents = documents.withColumn(field, F.lit(None).cast("string"))
    from leafwise.operators.indexing import document_terms

    blocks = stage(b.block_postings(document_terms(documents.withColumn("headings", F.array().cast("array<string>")).coalesce(1))), "blocks")
    terms = expanded.select(F.lit(1).cast("long").alias("query_id"), "field", "term", F.lit(1).cast("long").alias("mult"))
    depths = spark.createDataFrame([(1, 10)], "query_id long, depth int")

    def rows():
        found = b.best_rows(terms, expanded, depths, blocks, b.places_of(blocks), stats)
        return sorted((r["ord"], round(r["score"], 9)) for r in found.filter("ord is not null").collect())

    whole, sizes = rows(), []
    monkeypatch.setattr(b, "POSTINGS_AT_ONCE", 3)
    assert rows() == whole and len(whole) == 2
