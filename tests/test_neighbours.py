import re

import numpy as np
import pytest

from leafwise.operators import cells
from leafwise.operators import neighbours as nb
from leafwise.functions.vectors import cosine_similarity
from pyspark.sql import functions as F
from workload import queries


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    points = rng.standard_normal((400, 12)).astype(np.float32)
    points[50:90] = points[50]  # copies, to be ordered by id
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    rows += [(900, [0.0] * 12), (901, None), (902, [1.0])]
    vectors = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(6)
    queries = spark.createDataFrame(rows[:30] + [(900, [0.0] * 12)], "query_id long, embedding array<float>")
    return points, vectors, queries


def brute(points, q, k=10):
    unit = points.astype(float) / np.linalg.norm(points.astype(float), axis=1)[:, None]
    scores = np.round(0.9 * (1 + unit @ unit[q]) / 2, 6)
    return sorted(range(len(points)), key=lambda i: (-scores[i], i))[:k]


def by_query(rows):
    found = {}
    for r in rows:
        found.setdefault(r["query_id"], []).append((-round(r["score"], 6), r["doc_id"]))
    return {q: [d for _, d in sorted(x)] for q, x in found.items()}


def test_exact_equals_brute_force(data):
    points, vectors, queries = data
    found = by_query(nb.knn_top_k(vectors, queries).collect())
    assert found == {q: brute(points, q) for q in range(30)}


def test_a_large_batch_goes_by_blocks(data, monkeypatch):
    points, vectors, queries = data
    monkeypatch.setattr(nb, "QUERIES_AT_ONCE", 8)
    monkeypatch.setattr(nb, "VECTORS_AT_ONCE", 50)
    found = by_query(nb.knn_top_k(vectors, queries, k=3).collect())
    assert found == {q: brute(points, q, 3) for q in range(30)}


def test_small_blocks(data, monkeypatch):
    points, vectors, queries = data
    monkeypatch.setattr(nb, "ROWS_AT_ONCE", 7)
    assert by_query(nb.knn_top_k(vectors, queries).collect())[3] == brute(points, 3)


def recall(found, exact):
    return sum(len(set(exact[q]) & set(found.get(q, []))) for q in exact) / sum(map(len, exact.values()))


def test_approximate_recall(spark, data):
    points, vectors, queries = data
    exact = by_query(nb.knn_top_k(vectors, queries).collect())
    assert recall(by_query(cells.ann_knn(vectors, queries).collect()), exact) >= 0.9
    everything = cells.ann_knn(vectors, queries, num_candidates=1000, probes=cells.MAX_CELLS)
    assert by_query(everything.collect()) == exact


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall_on_the_registered_vectors(spark, folder):
    exact = by_query(queries.knn(spark, f"/root/testdata/{folder}").collect())
    share = recall(by_query(queries.ann(spark, f"/root/testdata/{folder}").collect()), exact)
    print(f"recall at 10 on {folder}: {share:.3f}")
    assert share >= 0.9


def test_stored_cells_give_the_same(spark, data, tmp_path):
    points, vectors, asked = data
    fresh = cells.index_vectors(vectors)
    cells.write_vector_index(vectors, str(tmp_path / "index"))
    stored = cells.read_vector_index(spark, str(tmp_path / "index"))
    assert by_query(cells.search_cells(stored, asked).collect()) == by_query(cells.search_cells(fresh, asked).collect())
    assert stored.codes.count() == len(points)  # zero, null and vectors of another length have no cell
    few = cells.candidates(stored, asked.limit(1), probes=1)
    assert re.search(r"PartitionFilters: \[[^\]]*cell#\d+ (=|IN)", few._jdf.queryExecution().executedPlan().toString())


def test_parts_and_blocks_of_a_crowded_cell(spark, data, monkeypatch):
    points, vectors, asked = data
    monkeypatch.setattr(cells, "ROWS", 16)
    monkeypatch.setattr(cells, "QUERIES", 4)
    exact = by_query(nb.knn_top_k(vectors, asked).collect())
    assert by_query(cells.ann_knn(vectors, asked, num_candidates=1000, probes=cells.MAX_CELLS, cells=3).collect()) == exact


def test_candidates_that_codes_cannot_leave_out_make_no_pairs(data, monkeypatch):
    points, vectors, asked = data
    exact = by_query(nb.knn_top_k(vectors, asked).collect())
    monkeypatch.setattr(cells, "knn_expression", lambda *a: pytest.fail("a table of pairs"))
    everything = cells.ann_knn(vectors, asked, num_candidates=1000, probes=cells.MAX_CELLS)
    assert by_query(everything.collect()) == exact


def test_a_block_has_more_queries_than_a_task_gets_whole(spark, data, monkeypatch):
    points, vectors, queries = data
    monkeypatch.setattr(nb, "QUERIES_AT_ONCE", 8)
    plan = nb._knn_blocks(vectors, queries.select(F.col("query_id").cast("bigint"), "embedding"), 3, 0.9)._jdf.queryExecution().toString()
    assert re.search(r"pmod\(xxhash64\(query_id#?\d*L?, 42\), 2\)", plan)


def test_no_vectors(spark, data):
    points, vectors, asked = data
    assert cells.ann_knn(vectors.limit(0), asked).collect() == []
    assert cells.ann_knn(vectors, asked.limit(0)).collect() == []


def test_codes_are_near_the_vectors(data):
    points, _, _ = data
    unit = points.astype(float) / np.linalg.norm(points.astype(float), axis=1)[:, None]
    centres = cells.k_means(unit, 8, 5)
    cell = cells.nearest_centres(unit, centres).argmax(axis=1)
    pieces = np.stack([cells.k_means(s, 64, 10) for s in cells._stretches(unit - centres[cell])])
    again = centres[cell] + cells._decoded(cells._encoded(unit - centres[cell], pieces), pieces, 12)
    assert ((again - unit) ** 2).sum(axis=1).mean() < 0.15


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<float>, b array<float>")
    found = [r[0] for r in rows.select(cosine_similarity(F.col("a"), F.col("b"))).collect()]
    assert found[0] == pytest.approx(2**-0.5) and found[1:] == [None, None]
