"""Whitening of embeddings by the covariance of their distinct quantised vectors.

Entries are quantised to whole numbers. Identical vectors are grouped, and each group
enters the fit with its weight: one, or its number of copies. Sums are exact whole
numbers, so that centring is exact, too; each task multiplies its centred vectors by
themselves and the partial products are added up. Only that matrix, as large as the
dimension squared, reaches the driver, whose eigenvectors go back to the tasks. Each
distinct vector is whitened once, and the rows are joined with the results.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwise.plans.staging import stage

#: Fixed values of the quantisation: ``floor(SCALE * c) + SHIFT``.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Eigenvalues up to this part of the largest count as zero.
ZERO = 1e-12
#: Vectors multiplied at a time.
ROWS_AT_ONCE = 4096


def _usable(embeddings: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``id, c`` of the rows whose vector has finite entries only, and one at least."""
    rows = embeddings.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{vector_column}`").cast("array<double>").alias("c"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return rows.filter((F.size("c") > 0) & F.forall("c", fine))


def _matrix(column: pa.Array, dim: int, kind=np.float64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)


def _sums(rows: DataFrame, column: str, weight, dim: int) -> list:
    """Exact weighted sums of each place of an array column; every task sends on one row."""
    added = [F.sum(F.element_at(column, i + 1) * weight) for i in range(dim)]
    return list(rows.agg(*added).first())


def gram(rows: DataFrame, column: str, dim: int, centred) -> np.ndarray:
    """Sum of ``weight * v v'`` over rows, where ``v = centred(matrix)``; the driver gets one matrix.

    ``rows`` has the array column and ``weight``. Tasks send on a row of partial sums
    for each line of the matrix, which are added up by line.
    """

    def multiply(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                v = centred(part.column(0), dim)
                total += (v * part.column(1).to_numpy(zero_copy_only=False)[:, None]).T @ v
        lines = pa.ListArray.from_arrays(np.arange(0, dim * dim + 1, dim, dtype=np.int32), pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), lines], ["line", "sums"])

    partial = rows.select(column, "weight").mapInArrow(multiply, "line int, sums array<double>")
    # a map of sums by place: the lines of many tasks are added up before they are shuffled
    added = F.array(*(F.sum(F.element_at("sums", i + 1)) for i in range(dim)))
    lines = partial.groupBy("line").agg(added.alias("sums")).collect()
    return np.array([r["sums"] for r in sorted(lines, key=lambda r: r["line"])]) if lines else np.zeros((dim, dim))


def _deviations(moved: np.ndarray) -> list:
    """Exact sums of squares of whole numbers; null where they leave 64 bits."""
    largest = float(np.abs(moved).max(initial=0))
    if largest * largest * moved.shape[1] < 2.0**62:
        return (moved * moved).sum(axis=1).tolist()
    exact = (sum(int(x) * int(x) for x in row) for row in moved)
    return [d if d < 1 << 63 else None for d in exact]


def whiten(
    embeddings: DataFrame,
    components: int = COMPONENTS,
    weights: str = "one",
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``, a row per vector and component.

    ``weights``: a distinct vector counts once in the fit (``one``), or as often as it
    occurs (``copies``); ``n`` is the sum of the weights. ``deviation`` is null where
    it does not fit 64 bits.

    Rows whose vector is null, empty or holds null or non-finite entries are left out,
    and so are those whose length is not the commonest (the longest of equally common
    ones). Rows that repeat an id or a vector all return. A vector of fewer dimensions
    has as many components. A component without variance has null ``whitened``, as
    division by its deviation has no result; ``explained`` is 0 there, or null if no
    component has any, and ``identity_error`` is over the others, or null. An empty
    table gives no rows. Other columns are left out. Entries beyond ``2 ** 52 / 64``
    are cut off there.
    """
    if weights not in ("one", "copies"):
        raise ValueError(weights)
    kind = embeddings.schema[id_column].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    usable = _usable(embeddings, id_column, vector_column)
    lengths = usable.groupBy(F.size("c").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.orderBy(F.desc("n"), F.desc("dim")).first()
    if common is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    dim = common["dim"]
    most = 2.0**52
    whole = F.transform("c", lambda c: F.floor(F.least(F.greatest(SCALE * c, F.lit(-most)), F.lit(most))) + SHIFT)
    rows = usable.filter(F.size("c") == dim).select("id", whole.alias("x"))
    weight = F.lit(1).cast("long") if weights == "one" else F.count(F.lit(1))
    distinct = stage(rows.groupBy("x").agg(weight.alias("weight")), "distinct_vectors")
    n = distinct.agg(F.sum("weight")).first()[0]
    added = _sums(distinct, "x", F.col("weight").cast("decimal(20,0)"), dim)
    sums = [int(s) for s in added]
    fits = max(abs(s) for s in sums) < 1 << 62 and n * (most + SHIFT) < 1 << 62
    exact = np.array(sums, dtype=np.int64 if fits else object)

    def moved(column, dim):
        """``n * x - S``, in whole numbers."""
        x = _matrix(column, dim, np.int64)
        if fits and n * float(np.abs(x).max(initial=0)) < 2.0**61:
            return n * x - exact
        return n * x.astype(object) - exact.astype(object)

    def centred(column, dim):
        return moved(column, dim).astype(np.float64) / n

    covariance = gram(distinct, "x", dim, centred) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(np.trace(covariance))
    kept = min(components, dim)
    alive = int((values[:kept] > ZERO * max(values[0], 0.0)).sum()) if values[0] > 0 else 0
    axes = vectors[:, :alive] / np.sqrt(values[:alive])

    def project(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                whole_moves = moved(part.column(0), dim)
                white = (whole_moves.astype(np.float64) / n) @ axes
                edges = np.arange(0, white.size + 1, alive or 1, dtype=np.int32)
                lists = pa.ListArray.from_arrays(edges if alive else np.zeros(part.num_rows + 1, dtype=np.int32), pa.array(white.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(_deviations(whole_moves), pa.int64()), lists], ["x", "weight", "deviation", "white"]
                )

    whitened = stage(
        distinct.select("x", "weight").mapInArrow(project, "x array<long>, weight long, deviation long, white array<double>"), "whitened_vectors"
    )
    error = None
    if alive:
        mean = np.array(_sums(whitened, "white", F.col("weight"), alive)) / n
        identity = gram(whitened, "white", alive, lambda column, size: _matrix(column, size) - mean) / n
        error = float(np.abs(identity - np.eye(alive)).max())
    shares = [float(max(v, 0.0)) / trace if trace > 0 else None for v in values[:kept]]
    of_component = F.array(
        *(
            F.struct(
                F.lit(i + 1).alias("component"),
                (F.element_at("white", i + 1) if i < alive else F.lit(None).cast("double")).alias("whitened"),
                F.lit(shares[i]).cast("double").alias("explained"),
            )
            for i in range(kept)
        )
    )
    joined = rows.join(whitened.select("x", "deviation", "white"), "x")
    return joined.select(F.col("id").alias("vec_id"), "deviation", F.explode(of_component).alias("of")).select(
        "vec_id", "of.component", F.lit(n).cast("long").alias("n"), "deviation", "of.whitened", "of.explained", F.lit(error).cast("double").alias("identity_error")
    )
