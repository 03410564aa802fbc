"""Whitening against NumPy."""

import numpy as np
import pytest

from leafwise.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<float>, x string, component int, weight string, id int"


def table(spark, vectors, schema=SCHEMA):
    return spark.createDataFrame([(i, v, "x", 1, "w", 0) for i, v in vectors], schema).repartition(5)


def cloud(n=300, dim=20, seed=1):
    random = np.random.default_rng(seed)
    points = (random.standard_normal((n, dim)) * np.linspace(0.3, 2, dim)).astype(np.float32)
    points[n // 2 : n // 2 + 60] = points[0]  # copies
    return [(i, [float(c) for c in p]) for i, p in enumerate(points)]


def brute(vectors, copies=False, components=16):
    x = np.array([np.floor(64 * np.array(v, dtype=np.float32).astype(float)) + 1_000_000 for _, v in vectors]).astype(np.int64)
    distinct, counts = np.unique(x, axis=0, return_counts=True)
    weights = counts if copies else np.ones(len(distinct), dtype=np.int64)
    n, sums = int(weights.sum()), (distinct * weights[:, None]).sum(axis=0)
    centred = (n * distinct - sums) / n
    covariance = (centred * weights[:, None]).T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    moved = n * x - sums
    return n, (moved * moved).sum(axis=1), moved / n @ axes / np.sqrt(values), values / np.trace(covariance)


@pytest.mark.parametrize("weights", ["one", "copies"])
def test_against_numpy(spark, weights):
    vectors = cloud()
    n, deviation, white, explained = brute(vectors, weights == "copies")
    rows = whiten(table(spark, vectors), weights=weights).collect()
    assert len(rows) == 300 * 16 and {r["n"] for r in rows} == {n}
    assert all(r["deviation"] == deviation[r["vec_id"]] for r in rows)
    found = np.zeros((300, 16))
    for r in rows:
        found[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9)
    signs = np.sign((found * white).sum(axis=0))
    assert np.allclose(found * signs, white, atol=1e-7)
    errors = {r["identity_error"] for r in rows}
    assert len(errors) == 1 and errors.pop() < 1e-9


def test_awkward_rows(spark):
    inf, nan = float("inf"), float("nan")
    good = cloud(40, 3)
    bad = [(900, None), (901, []), (902, [1.0, None, 2.0]), (903, [nan, 1.0, 1.0]), (904, [1.0, inf, 1.0]), (905, [1.0, 2.0])]
    rows = whiten(table(spark, good + bad + good[:5] + [(None, good[0][1])])).collect()
    assert len(rows) == 3 * 46  # repeated rows and a null id return, too
    assert {r["component"] for r in rows} == {1, 2, 3}
    _, deviation, _, explained = brute(good)
    assert all(r["deviation"] == deviation[r["vec_id"]] for r in rows if r["vec_id"] is not None)
    assert sum({r["explained"] for r in rows}) == pytest.approx(1)


def test_no_variance(spark):
    rows = whiten(table(spark, [(i, [1.0, 2.0]) for i in range(4)])).collect()
    assert len(rows) == 8 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in rows} == {(1, 0, None, None, None)}
    flat = whiten(table(spark, [(i, [float(i), 2.0]) for i in range(4)])).collect()
    assert {(r["component"], r["whitened"] is None) for r in flat} == {(1, False), (2, True)}
    assert {r["explained"] for r in flat} == {1.0, 0.0} and all(r["identity_error"] < 1e-9 for r in flat)


def test_large_entries_are_exact(spark):
    """Sums of squares beyond 64 bits are null, those below exact."""
    vectors = [(0, [1e9, 0.0]), (1, [0.0, 0.0]), (2, [0.5, 3.0])]
    rows = {r["vec_id"]: r["deviation"] for r in whiten(table(spark, vectors)).collect()}
    assert rows[0] is None and rows[1] is None
    small = [(0, [1e6, 0.0]), (1, [0.0, 0.0]), (2, [0.5, 3.0])]
    _, deviation, _, _ = brute(small)
    assert {r["vec_id"]: r["deviation"] for r in whiten(table(spark, small)).collect()} == dict(enumerate(deviation.tolist()))


def test_empty_table_and_text_ids(spark):
    assert whiten(table(spark, cloud(2, 2)).limit(0)).collect() == []
    named = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [2.0, 2.5])], "vec_id string, embedding array<double>")
    assert {r["vec_id"] for r in whiten(named).collect()} == {"a", "b"}
