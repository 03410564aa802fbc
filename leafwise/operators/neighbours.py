"""Nearest neighbours by cosine, exact; ``operators.cells`` has the approximate ones."""

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwise.functions.vectors import cosine_similarity
from leafwise.operators.ranking import score_order
from leafwise.plans.groups import runs_of
from leafwise.plans.joins import join_small, top_per_group
from leafwise.schema import KNN_BOOST, KNN_K, SCORE_DIGITS

# Send the task functions below along with the job, so that executors need not have
# this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Query vectors that every task may hold, vectors of a part that meets a block of a larger batch, and numbers in such a block.
QUERIES_AT_ONCE = 2048
VECTORS_AT_ONCE = 32768
NUMBERS_AT_ONCE = 1 << 21
# Vectors and queries that are multiplied at a time.
ROWS_AT_ONCE, QUERIES_SCORED = 4096, 1024


def knn_score(cosine, boost=KNN_BOOST):
    return F.lit(boost) * (1 + cosine) / 2


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int):
    """Rows of the given length as a matrix of doubles, with the row numbers kept."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    keep = np.flatnonzero(lengths == dim)
    values = column.take(pa.array(keep)).flatten().fill_null(np.nan)
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim), keep


def _normalised(matrix):
    norms = np.sqrt((matrix * matrix).sum(axis=1))
    usable = np.isfinite(norms) & (norms > 0)
    return matrix / np.where(usable, norms, 1.0)[:, None], usable


def _first_k(owner, scores, ids, k):
    """Places of each owner's k best, owner by owner: rounded score descending, then id."""
    order = np.lexsort((ids, -np.round(scores, SCORE_DIGITS), owner))
    owner = owner[order]
    begins = np.flatnonzero(np.concatenate((np.ones(min(1, len(owner)), dtype=bool), np.diff(owner) != 0)))
    rank = np.arange(len(owner)) - np.repeat(begins, np.diff(np.append(begins, len(owner))))
    return order[rank < k]


def _ids(column):
    """Ids as numbers if they are, else as objects."""
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.asarray(column.to_pylist(), dtype=object)


def _partial_top_k(query_ids, query_matrix, k, boost):
    """Task function: the k best of a partition for each query, batch by batch.

    A score is looked at only if it reaches the k-th best that its query has so far.
    """
    unit_queries, usable = _normalised(query_matrix)
    unit_queries, query_ids = unit_queries[usable], query_ids[usable]
    dim = query_matrix.shape[1]

    def run(batches):
        owner, kept_scores, kept_ids = np.zeros(0, dtype=np.int64), np.zeros(0), None
        least = np.full(len(query_ids), -np.inf)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                block = batch.slice(start, ROWS_AT_ONCE)
                matrix, rows = _matrix(block.column(1), dim)
                unit, fine = _normalised(matrix)
                unit, rows = unit[fine], rows[fine]
                if not len(rows):
                    continue
                ids = _ids(block.column(0).take(pa.array(rows)))
                parts = [(owner, kept_scores, ids[:0] if kept_ids is None else kept_ids)]
                for q in range(0, len(query_ids), QUERIES_SCORED):
                    cosines = unit_queries[q : q + QUERIES_SCORED] @ unit.T
                    floor = 2 * (least[q : q + QUERIES_SCORED] - 10.0**-SCORE_DIGITS) / boost - 1 if boost > 0 else np.full(len(cosines), -np.inf)
                    if boost > 0 and len(rows) > k and not np.isfinite(floor).all():
                        floor = np.maximum(floor, np.partition(cosines, len(rows) - k, axis=1)[:, len(rows) - k] - 4 * 10.0**-SCORE_DIGITS / boost)
                    near = np.flatnonzero(cosines >= floor[:, None])
                    of, row = np.divmod(near, len(rows))
                    parts.append((of + q, boost * (1 + cosines.ravel()[near]) / 2, ids[row]))
                owner, kept_scores, kept_ids = (np.concatenate(c) for c in zip(*parts))
                best = _first_k(owner, kept_scores, kept_ids, k)
                owner, kept_scores, kept_ids = owner[best], kept_scores[best], kept_ids[best]
                full = np.flatnonzero(np.bincount(owner, minlength=len(query_ids)) == k)
                last = np.searchsorted(owner, full, side="right") - 1
                least[full] = np.round(kept_scores[last], SCORE_DIGITS)
        if len(owner):
            yield query_ids[owner], kept_ids, kept_scores

    return run


def _empty(vectors):
    id_type = vectors.schema["id"].dataType.simpleString()
    schema = f"query_id bigint, doc_id {id_type}, score double"
    return vectors.sparkSession.createDataFrame([], schema), schema


def _batch_of(query_ids, ids, scores, arrow_id):
    return pa.RecordBatch.from_arrays(
        [pa.array(query_ids, pa.int64()), pa.array(list(ids), arrow_id), pa.array(scores, pa.float64())],
        names=["query_id", "doc_id", "score"],
    )


def _arrow_id(vectors):
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[vectors.schema["id"].dataType.simpleString()]


def _knn_small(vectors, rows, k, boost):
    """The best of each partition for a batch that every task holds."""
    empty, schema = _empty(vectors)
    rows = [r for r in rows if r["embedding"] is not None]
    dims = {len(r["embedding"]) for r in rows}
    if not dims:
        return empty
    if len(dims) > 1:
        raise ValueError(f"query vectors of different lengths: {sorted(dims)}")
    query_ids = np.array([r["query_id"] for r in rows])
    matrix = np.array([r["embedding"] for r in rows], dtype=np.float64)
    top_k, arrow_id = _partial_top_k(query_ids, matrix, k, boost), _arrow_id(vectors)

    def run(batches):
        for names_of, ids, scores in top_k(batches):
            yield _batch_of(names_of, ids, scores, arrow_id)

    return vectors.select("id", "embedding").mapInArrow(run, schema)


def _knn_blocks(vectors, queries, k, boost, dim=0):
    """The same for a batch of any size: blocks of queries meet parts of the vectors.

    One plan for all blocks. A group has a part of the vectors and a block of queries,
    so that what a task holds has a bound; vectors go to one group for each block. A
    block is as large as queries of ``dim`` numbers allow, as each takes all vectors.
    """
    _, schema = _empty(vectors)
    arrow_id = _arrow_id(vectors)
    n_queries, n_vectors = queries.count(), vectors.count()
    least, parts = 2 * QUERIES_AT_ONCE, max(1, -(-n_vectors // VECTORS_AT_ONCE))
    size = max(least, min(VECTORS_AT_ONCE, NUMBERS_AT_ONCE // dim)) if dim else least
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n_queries // size), min(-(-n_queries // least), -(-cores // parts)))  # a task for each core, if there are so many
    none = lambda c, table: F.lit(None).cast(table.schema[c].dataType).alias(c)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    rows = vectors.select(every(blocks).alias("block"), place("id", parts).alias("part"), none("query_id", queries), "id", "embedding")
    asked = queries.select(place("query_id", blocks).alias("block"), every(parts).alias("part"), "query_id", none("id", vectors), F.col("embedding").cast(vectors.schema["embedding"].dataType))
    on = ["block", "part"]
    met = rows.unionByName(asked).repartition(min(4096, 4 * blocks * parts), *on).sortWithinPartitions(*on)  # groups take long, so each gets a task

    def run(batches):
        for _, group in runs_of(batches, on):
            stored = group.column("query_id").is_null()
            vectors_here, asked_here = group.filter(stored), group.filter(pc.invert(stored))
            column = asked_here.column("embedding").combine_chunks() if asked_here.num_rows else None
            if column is None or not vectors_here.num_rows:
                continue
            lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            if len(set(lengths[lengths >= 0].tolist())) > 1:
                raise ValueError("query vectors of different lengths")
            if lengths.max() < 0:
                continue
            matrix, keep = _matrix(column, int(lengths.max()))
            names = asked_here.column("query_id").to_numpy(zero_copy_only=False)[keep]
            pieces = vectors_here.select(["id", "embedding"]).combine_chunks().to_batches()
            for names_of, ids, scores in _partial_top_k(names, matrix, k, boost)(pieces):
                yield _batch_of(names_of, ids, scores, arrow_id)

    return met.mapInArrow(run, schema)


def knn_top_k(vectors: DataFrame, queries: DataFrame, k=KNN_K, boost=KNN_BOOST) -> DataFrame:
    """``(query_id, doc_id, score)`` of each query's k nearest vectors.

    A batch of up to ``QUERIES_AT_ONCE`` queries goes to the tasks whole, and vectors
    are not shuffled: each task multiplies its vectors with the query matrix and passes
    on its k best per query. Of a larger batch nothing reaches the driver; its blocks
    and parts of the vectors are brought together. A ranked window merges the best.
    """
    queries = queries.select(F.col("query_id").cast("bigint"), "embedding")
    rows = queries.limit(QUERIES_AT_ONCE + 1).collect()
    dim = max((len(r["embedding"]) for r in rows if r["embedding"] is not None), default=0)
    partial = _knn_small(vectors, rows, k, boost) if len(rows) <= QUERIES_AT_ONCE else _knn_blocks(vectors, queries, k, boost, dim)
    best = top_per_group(partial, "query_id", score_order(), k, salt_by="doc_id")
    return best.select("query_id", "doc_id", "score")


def knn_expression(vectors: DataFrame, queries: DataFrame, pairs: DataFrame, boost=KNN_BOOST) -> DataFrame:
    """Scores of given ``(query_id, doc_id)`` pairs with built-in functions only."""
    asked = queries.select("query_id", F.col("embedding").alias("query_vector"))
    stored = vectors.select(F.col("id").alias("doc_id"), "embedding")
    met = join_small(stored, pairs, "doc_id", salt_by="embedding")
    joined = join_small(met, asked, "query_id", salt_by="doc_id")
    cosine = cosine_similarity(F.col("query_vector"), F.col("embedding"))
    scored = joined.select("query_id", "doc_id", knn_score(cosine, boost).alias("score"))
    return scored.filter(F.col("score").isNotNull())
