from pyspark.sql import functions as F

from leafwise.functions.encoders import hash_encoder
from leafwise.operators import indexing, maintenance, parsing, ranking, scoring
from leafwise.operators.matching import expand_words, query_terms, with_defaults, word_table
from leafwise.plans import joins, staging
from leafwise.sources.tables import build_index
from tests.conftest import SMALLEST
from workload import inputs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parsing_and_postings_are_narrow(spark):
    files = staging.stage(inputs.reports(spark, SMALLEST), "files")
    for df in (parsing.parse_documents(files), indexing.build_postings(parsing.parse_documents(files))):
        assert "Exchange" not in plan(df) and "Python" not in plan(df)


def test_parsing_reads_needed_columns(spark):
    files = staging.stage(inputs.reports(spark, SMALLEST), "files")
    assert "ReadSchema: struct<file_path:string>" in plan(parsing.classify_files(files).select("file_type"))


def test_scoring_shuffles_postings_once(spark):
    index = build_index(staging.stage(inputs.parsed(spark, SMALLEST), "documents"), hash_encoder())
    terms = query_terms(with_defaults(inputs.queries(spark, SMALLEST)))
    expanded = expand_words(word_table(terms), index.term_stats)
    text = plan(scoring.keyword_scores(terms, expanded, index.postings, index.field_stats))
    assert "Python" not in text and text.count("REPARTITION_BY_COL") == 1
    assert "Exchange hashpartitioning(query_id#" not in text.replace("term#", "").split("BroadcastExchange")[0]


def test_ranks_are_cut_before_the_shuffle(spark):
    scores = staging.stage(
        spark.range(100).select(F.lit(1).alias("query_id"), F.col("id").alias("doc_id"), F.rand(1).alias("score")), "scores"
    )
    queries = with_defaults(spark.createDataFrame([(1, "q")], "query_id long, query string"))
    assert "WindowGroupLimit" in plan(ranking.rank_and_page(scores, queries))
    assert "WindowGroupLimit" in plan(maintenance.latest(scores, "query_id", [F.desc("score")]))


def test_deep_ranks_are_cut_by_salted_groups(spark):
    rows = spark.range(5000).select(F.lit(1).alias("g"), "id")
    deep = joins.top_per_group(rows, "g", [F.desc("id")], 2000, salt_by="id")
    assert [r["id"] for r in deep.orderBy("rank").collect()] == list(range(4999, 2999, -1))
    assert plan(deep).count("row_number") > 1


def test_join_beyond_the_broadcast_bound(spark, monkeypatch):
    big = spark.range(3000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    small = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c")], "k long, w string")
    wanted = sorted(map(tuple, big.join(small, "k").select("k", "v", "w").collect()))
    assert "BroadcastHashJoin" in plan(joins.join_small(big, small, "k"))
    monkeypatch.setattr(joins, "fits_broadcast", lambda *a, **k: False)
    found = joins.join_small(big, small, "k", salt_by="v")
    assert sorted(map(tuple, found.select("k", "v", "w").collect())) == wanted


def test_a_side_found_too_large_is_never_broadcast(spark, monkeypatch):
    big = staging.stage(spark.range(3000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v")), "big")
    small = staging.stage(spark.range(3).select(F.col("id").alias("k"), F.lit("a").alias("w")), "small")
    monkeypatch.setattr(joins, "fits_broadcast", lambda *a, **k: False)
    for salt_by in (None, "v"):
        for splits in ("true", "false"):
            spark.conf.set("spark.sql.adaptive.skewJoin.enabled", splits)
            try:
                found = joins.join_small(big, small, "k", salt_by=salt_by)
                assert found.count() == 3000 and "BroadcastHashJoin" not in plan(found)
            finally:
                spark.conf.unset("spark.sql.adaptive.skewJoin.enabled")


def test_sizes_are_measured(spark):
    rows = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("t"))
    assert joins.fits_broadcast(rows)
    assert not joins.fits_broadcast(rows, max_rows=99)
    assert not joins.fits_broadcast(rows, max_bytes=50_000)


def test_staging_uses_the_shared_folder(spark):
    rows = staging.stage(spark.range(3), "x")
    assert rows.count() == 3 and staging.shared_dir(spark) in rows.inputFiles()[0]
