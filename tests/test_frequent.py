import pytest
from pyspark.sql import functions as F

from leafwise.functions.encoders import hash_encoder
from leafwise.operators import blocks as b
from leafwise.operators import scoring
from leafwise.plans import joins
from leafwise.plans import search as s
from leafwise.plans.staging import stage
from leafwise.sources import tables

SCHEMA = "id string, title string, headings array<string>, background string, scope string, content string"


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def sides(spark):
    """A key in 64 rows, one in 8, some in one, and keys that the small side lacks."""
    keys = ["a"] * 64 + ["b"] * 8 + ["c", "d", "x", "y", None]
    big = stage(spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "term string, i long"), "big")
    small = stage(spark.createDataFrame([("a", 1, 64), ("b", 2, 8), ("c", 3, 1), ("d", 4, 1), (None, 5, 1)], "term string, list long, df long"), "small")
    return big, small


@pytest.mark.parametrize("bound", [(0, 1 << 20), (1, 1 << 20), (2, 1 << 20), (100, 1 << 20), (100, 10)])
def test_join_of_frequent_and_rare_keys(sides, monkeypatch, bound):
    big, small = sides
    monkeypatch.setattr(joins.split_frequent, "__defaults__", bound)
    assert rows(joins.join_frequent(big, small, "term", "df")) == rows(big.join(small, "term"))


def test_only_rare_keys_are_shuffled(sides, monkeypatch):
    big, small = sides
    monkeypatch.setattr(joins.split_frequent, "__defaults__", (2, 1 << 20))
    often, seldom = joins.split_frequent(small, "df")
    assert [r["term"] for r in often.orderBy("term").collect()] == ["a", "b"]
    assert sorted(r["term"] or "" for r in seldom.collect()) == ["", "c", "d"]
    assert joins.without_frequent(big, often, ["term"]).count() == 5


@pytest.fixture(scope="module")
def documents(spark):
    texts = ["the tide is low", "the moon moves the tide", "a rare wordd", "the the the moon"]
    return stage(spark.createDataFrame([(f"d{i}", f"title {i}", ["HEAD"], None, text, text) for i, text in enumerate(texts)], SCHEMA), "documents")


def test_scores_with_lists_beyond_a_broadcast(spark, documents, monkeypatch):
    """Lists of rare terms go with their postings; scores are those of lists that are broadcast."""
    from leafwise.operators.matching import query_terms, with_defaults

    index = tables.build_index(documents, hash_encoder())
    terms = query_terms(with_defaults(spark.createDataFrame([(1, "the tide word"), (2, "moon")], "query_id long, query string")))
    scores = lambda: [(q, d, round(v, 9)) for q, d, v in rows(scoring.keyword_scores(terms, s.expand(terms, index), index.postings, index.field_stats).select("query_id", "doc_id", "score"))]
    whole = scores()
    assert len(whole) > 4
    monkeypatch.setattr(scoring, "fits_broadcast", lambda *a, **k: False)
    for n in (0, 2):
        monkeypatch.setattr(joins.split_frequent, "__defaults__", (n, 1 << 20))
        assert scores() == whole


def test_blocks_keep_lengths_once_for_each_document(spark, documents):
    index = tables.build_index(documents, hash_encoder())
    assert "dls" not in index.blocks.columns
    sizes = index.blocks.filter("ids is not null").select(F.size("ids").alias("n"), F.size("lengths").alias("m")).collect()
    assert sizes and all(r["m"] == 5 * r["n"] for r in sizes)
    found = b.postings_from(index.blocks, index.places).select("field", "term", "doc_id", "tf", "dl")
    assert rows(found) == rows(index.postings.select("field", "term", "doc_id", "tf", "dl"))
    assert rows(index.field_stats.select("field", "n_docs")) == [("content", 4), ("headings", 4), ("scope", 4), ("title", 4)]


@pytest.mark.parametrize("least", [0, 1 << 20])
def test_blocks_travel_in_parcels(spark, monkeypatch, least):
    """All blocks that a batch has for a group of queries in a shard are one row, in as few bytes as they need."""
    import pyarrow as pa

    monkeypatch.setattr(b, "PARCEL", least)
    n = 600
    lists = lambda values, kind: pa.array([[v] for v in values], pa.list_(kind))
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array([0] * n, pa.int32()), pa.array([i % 2 for i in range(n)], pa.int64()), pa.array(["content"] * n), pa.array([2.5] * n),
            lists(range(n), pa.int64()), lists([0.5] * n, pa.float64()), lists(range(n), pa.int32()), lists([1] * n, pa.int32()),
        ],
        ["queries", "shard", "field", "avgdl", "term_ids", "factors", "ords", "tfs"],
    )
    (found,) = b._parcels([batch])
    assert found.num_rows == 2
    opened = b._opened(found.column("parcel").to_pylist())
    assert sorted(opened["term"].tolist()) == list(range(n)) and sorted(opened["ord"].tolist()) == list(range(n))
    assert set(opened["field"].tolist()) == {4} and set(opened["mean"].tolist()) == {2.5}
