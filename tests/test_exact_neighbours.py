import numpy as np
from pyspark.sql import functions as F

from leafwise.operators import neighbours as nb


def test_ties_and_small_parts_of_neighbours(monkeypatch):
    """The k best by rounded score, then id, whatever the sizes of the pieces."""
    import pyarrow as pa

    random = np.random.default_rng(3)
    vectors = np.repeat(random.integers(-3, 4, (40, 4)), 3, axis=0).astype(float)
    queries = random.integers(-3, 4, (30, 4)).astype(float) + 0.5
    unit = lambda m: m / np.maximum(np.sqrt((m * m).sum(axis=1)), 1e-300)[:, None]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(vectors))[::-1]), pa.array(vectors.tolist())], ["id", "embedding"])
    monkeypatch.setattr(nb, "ROWS_AT_ONCE", 11)
    monkeypatch.setattr(nb, "QUERIES_SCORED", 7)
    ((names, ids, scores),) = nb._partial_top_k(np.arange(30), queries, 5, 0.9)([batch])
    usable = np.flatnonzero((vectors != 0).any(axis=1))
    for q in range(30):
        exact = np.round(0.9 * (1 + unit(vectors) @ unit(queries)[q]) / 2, 6)
        order = sorted(usable, key=lambda r: (-exact[r], len(vectors) - 1 - r))[:5]
        assert ids[names == q].tolist() == [len(vectors) - 1 - r for r in order]


def test_a_query_goes_to_large_parts_of_all_vectors(spark):
    """A vector is sent to blocks of many queries, so copies grow with the square only in steps of a block."""
    vectors = spark.range(10_000).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    queries = vectors.select(F.col("id").alias("query_id"), "embedding")
    met = nb._knn_blocks(vectors, queries, 3, 0.9, 2)._jdf.queryExecution().optimizedPlan().toString()
    cores = spark.sparkContext.defaultParallelism
    assert f"RepartitionByExpression [block#" in met and f", {4 * min(cores, 3)}" in met
