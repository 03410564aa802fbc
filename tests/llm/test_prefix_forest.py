"""The forest of hash prefixes against brute force."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from leafwise.llm import prefix_forest as pf

GIVEN = "/root/testdata/sf0.1/embeddings.parquet"


def table(spark, vectors):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], "x", 1, 2, 3, "k") for i, v in vectors]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, cls string, `dim` int, tree int, n int, `key` string").repartition(5)


def brute(vectors, queries, k=20):
    found = {}
    usable = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in vectors if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    usable = list({(i, v.tobytes()): (i, v) for i, v in usable if i is not None}.values())
    for q, v in usable:
        if q in queries:
            scores = [(-round(float((v * w).sum()), 12), i) for i, w in usable if i != q and len(w) == len(v)]
            found[q] = sorted(scores)[:k]
    return {q: f for q, f in found.items() if f}


def by_query(df):
    found = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        mine = found.setdefault(r["query_id"], [])
        assert r["rank"] == len(mine) + 1
        mine.append((-round(r["score"], 12), r["vec_id"]))
    return found


def search(spark, vectors, **more):
    rows = table(spark, vectors)
    return by_query(pf.nearest(rows, rows.filter("vec_id % 5 = 0"), **more))


def recall(found, exact):
    hits = sum(len({i for _, i in found.get(q, [])} & {i for _, i in e}) for q, e in exact.items())
    return hits / sum(map(len, exact.values()))


def clustered(n, seed=2):
    """Clouds around centres, of which one has a third of all rows, and exact copies."""
    random = np.random.default_rng(seed)
    centres = random.standard_normal((40, 32))
    which = np.where(np.arange(n) % 3 == 0, 0, random.integers(0, 40, n))
    points = (centres[which] + 0.3 * random.standard_normal((n, 32))).astype(np.float32)
    points[n // 2 : n // 2 + 90] = points[7]
    return [(i, p.tolist()) for i, p in enumerate(points)]


def test_given_vectors(spark):
    given = pq.read_table(GIVEN)
    vectors = list(zip(given.column("vec_id").to_pylist(), given.column("embedding").to_pylist()))
    queries = {i for i, _ in vectors if i % 20 == 0}
    rows = spark.read.parquet(GIVEN)
    found = by_query(pf.nearest(rows, rows.filter("vec_id % 20 = 0")))
    assert set(found) == queries and recall(found, brute(vectors, queries)) >= 0.9


def test_clusters_and_copies(spark, monkeypatch):
    """Prefixes of several depths, many parts and crowded ones; every score is exact."""
    monkeypatch.setattr(pf, "ROWS", 100)
    monkeypatch.setattr(pf, "QUERIES", 40)
    vectors = clustered(2400)
    exact = brute(vectors, {i for i, _ in vectors if i % 5 == 0})
    found = search(spark, vectors)
    assert recall(found, exact) >= 0.9
    known = {i: np.array(v, dtype=np.float32).astype(float) for i, v in vectors}
    assert all(abs(-s - float((known[q] * known[i]).sum())) < 1e-9 for q, f in found.items() for s, i in f)


def test_without_safe_prefix_all_rows_are_met(spark, monkeypatch):
    monkeypatch.setattr(pf, "ROWS", 64)
    vectors = clustered(900, seed=4)
    assert search(spark, vectors, recall=1.1) == brute(vectors, {i for i, _ in vectors if i % 5 == 0})


def test_products_of_unequal_lengths(spark):
    """The largest inner product is wanted, not the largest cosine."""
    random = np.random.default_rng(8)
    points = random.standard_normal((800, 16)) * random.uniform(0.1, 4, (800, 1))
    vectors = [(i, p.astype(np.float32).tolist()) for i, p in enumerate(points)]
    assert recall(search(spark, vectors), brute(vectors, {i for i, _ in vectors if i % 5 == 0})) >= 0.9


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1.0, 0.0]), (5, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, []), (10, [0.0, 0.0]), (15, [nan, 1.0]), (20, [1.0, inf])]
    vectors += [(25, [1.0, None]), (30, [1.0, 2.0, 3.0]), (31, [1.0, 2.0, 3.5]), (None, [3.0, 3.0]), (0, [1.0, 0.0]), (40, [2.0, 1.0]), (40, [2.0, 1.5]), (35, [4.0])]
    exact = brute([v for v in vectors if v[0] != 40], {0, 5, 30})
    found = search(spark, [v for v in vectors if v[0] != 40])
    assert found == exact  # 35 has no candidate of its length
    twice = table(spark, vectors)
    rows = pf.nearest(twice, twice.filter("vec_id = 40"), k=3).collect()
    assert len(rows) == 6 and 40 not in {r["vec_id"] for r in rows}  # an id with two vectors is asked twice


def test_many_copies_go_by_id(spark):
    vectors = [(i, [0.6, 0.8]) for i in range(700)] + [(1000, [0.0, 1.0])]
    found = search(spark, vectors)
    assert [i for _, i in found[0]] == list(range(1, 21)) and [i for _, i in found[10]] == [*range(10), *range(11, 21)]


def test_empty_tables_and_text_ids(spark):
    rows = table(spark, [(1, [1.0, 2.0]), (2, [1.0, 1.0])])
    assert pf.nearest(rows.limit(0), rows).collect() == [] and pf.nearest(rows, rows.limit(0)).collect() == []
    named = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [2.0, 2.5]), ("c", [2.0, 2.5])], "vec_id string, embedding array<double>")
    found = [tuple(r) for r in pf.nearest(named, named.filter("vec_id = 'a'")).collect()]
    assert found == [("a", 1, "b", 7.0), ("a", 2, "c", 7.0)]


@pytest.mark.parametrize("cosine", [0.4, 0.8])
def test_chance_of_a_shared_symbol(cosine):
    random = np.random.default_rng(1)
    one, other = random.standard_normal((2, 4000, 24))
    one /= np.linalg.norm(one, axis=1)[:, None]
    other -= (other * one).sum(axis=1)[:, None] * one
    two = cosine * one + np.sqrt(1 - cosine**2) * other / np.linalg.norm(other, axis=1)[:, None]
    flat = lambda m: pf.strings(np.column_stack((m, np.zeros(len(m)))), 4, 5) >> (pf.BITS * (pf.SYMBOLS - 1))
    assert abs((flat(one) == flat(two)).mean() - np.interp(cosine, *pf.shared_symbol())) < 0.02
