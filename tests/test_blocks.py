import pytest
from pyspark.sql import functions as F

from leafwise.functions.encoders import hash_encoder
from leafwise.operators import blocks as b
from leafwise.operators import scoring
from leafwise.operators.indexing import build_postings, document_terms
from leafwise.operators.matching import query_terms, with_defaults
from leafwise.operators.neighbours import knn_top_k
from leafwise.operators.ranking import count_total, rank_and_page
from leafwise.plans import search as s
from leafwise.plans.staging import stage
from leafwise.sources import tables
from tests.conftest import SMALLEST
from workload import inputs

ENCODER = hash_encoder(16)


@pytest.fixture(scope="module")
def index(spark):
    return tables.build_index(stage(inputs.parsed(spark, SMALLEST), "documents"), ENCODER)


@pytest.fixture(scope="module")
def asked(spark):
    return stage(with_defaults(inputs.paged_queries(spark, SMALLEST)).filter("query_id >= 0"), "asked")


@pytest.fixture(scope="module")
def words(index, asked):
    terms = query_terms(asked)
    return terms, s.expand(terms, index)


@pytest.fixture(scope="module")
def whole(index, asked, words):
    """Pages and totals from the table of all hits."""
    terms, expanded = words
    keyword = scoring.keyword_scores(terms, expanded, index.postings, index.field_stats)
    hits = stage(scoring.hybrid_fuse(keyword, knn_top_k(index.vectors, s.query_vectors(asked, ENCODER))), "hits")
    return listed(rank_and_page(hits, asked)), listed(count_total(hits, asked))


def listed(df):
    df = df.withColumn("score", F.round("score", 6)) if "score" in df.columns else df
    return sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())


def small_shards(index, monkeypatch, documents=40, run=8):
    monkeypatch.setattr(b, "RUN", run)
    shards = stage(b.block_postings(document_terms(index.documents), documents), "small_blocks")
    return tables.Index(**{**index.__dict__, "blocks": shards, "places": b.places_of(shards)})


def test_same_as_the_table_of_hits(index, asked, words, whole):
    pages, totals = s.search_pages(asked, index, ENCODER, *words)
    assert (listed(pages), listed(totals)) == whole


@pytest.mark.parametrize("skip", [True, False])
def test_skipped_runs_change_nothing(index, asked, words, whole, monkeypatch, skip):
    monkeypatch.setattr(b, "QUERIES", 7)
    monkeypatch.setattr(b, "FIRST_RUNS", 1)
    pages, totals = s.search_pages(asked, small_shards(index, monkeypatch), ENCODER, *words, skip=skip)
    assert (listed(pages), listed(totals)) == whole


def test_runs_are_skipped(spark, index, asked, words, monkeypatch):
    """Most runs are not scored for a query whose best documents are found early."""
    small = small_shards(index, monkeypatch, 400, 4)
    depths = asked.select("query_id", F.lit(3).alias("depth"))
    found = b.best_rows(*words, depths, small.blocks, small.places, small.field_stats)
    scored, runs = found.agg(F.sum("scored_runs"), F.sum("runs")).first()
    assert scored < 0.8 * runs
    every = b.best_rows(*words, depths, small.blocks, small.places, small.field_stats, skip=False)
    assert every.count() >= found.count()
    again = lambda rows: listed(rank_and_page(b.page_scores(rows, small.places), asked.withColumn("page", F.lit(1)).withColumn("page_size", F.lit(3))))
    assert again(found) == again(every)


def test_blocks_hold_all_postings(spark, index):
    shards = stage(b.block_postings(document_terms(index.documents), 30), "blocks")
    again = b.postings_from(shards, b.places_of(shards))
    columns = ["field", "term", "doc_id", "tf", "dl"]
    assert sorted(map(tuple, again.select(*columns).collect())) == sorted(map(tuple, build_postings(index.documents).select(*columns).collect()))
    sizes = [r["size"] for r in shards.filter("ids IS NOT NULL").select(F.size("ids").alias("size")).collect()]
    assert max(sizes) <= 30 and sum(sizes) == index.documents.count()


def test_blocks_are_built_without_a_shuffle(index):
    plan = b.block_postings(document_terms(index.documents))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_each_page_has_its_own_depth(spark, index):
    """A deep page of one query does not make the others give out more rows."""
    rows = [(0, "the", 1, 5), (1, "the", 40, 5)]
    asked = with_defaults(spark.createDataFrame(rows, "query_id long, query string, page int, page_size int"))
    text = index.documents.select(F.explode(F.split("content", " ")).alias("w")).groupBy("w").count().orderBy(F.desc("count")).first()["w"]
    asked = asked.withColumn("query", F.lit(text))
    terms = query_terms(asked)
    expanded = s.expand(terms, index, fuzzy=False)
    depths = asked.select("query_id", (F.col("page") * F.col("page_size")).alias("depth"))
    found = b.best_rows(terms, expanded, depths, index.blocks, index.places, index.field_stats)
    tasks = found.select("shard").distinct().count()
    given = {r["query_id"]: r["count"] for r in found.filter("ord IS NOT NULL").groupBy("query_id").count().collect()}
    assert given[0] <= 5 * tasks < given[1]


def test_empty_index_and_no_queries(spark, index, asked):
    empty = tables.build_index(index.documents.limit(0), ENCODER)
    found = s.search_documents(asked, empty, ENCODER)
    assert found.collect() == []
    assert s.search_documents(asked.limit(0), index, ENCODER).collect() == []
