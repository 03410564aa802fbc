"""An encoder learned from a corpus: truncated singular vectors of its term-document table.

Terms are hashed to a fixed number of rows, so that what is learned has a bounded size
whatever the vocabulary. Every pass reads the staged term counts once and stays in its
tasks: a task weights its documents, multiplies them with the current directions and
sends on partial sums for each row of the table. The driver makes the summed directions
orthogonal and, at the end, solves a problem of the size of the rank. Texts that share
no word but words of the same company come to lie near each other.
"""

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from leafwise.functions.text import tokenize
from leafwise.schema import EMBEDDED_FIELDS

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # for executors without this package

RANK, MORE = 64, 16
#: Rows that terms are hashed to; what the driver and a task hold is this times the rank.
ROWS = 1 << 15
ROUNDS = 2
AT_ONCE = 50_000


def term_row(term: str, rows: int) -> int:
    return int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % rows


def _counts(batch: pa.RecordBatch, rows: int):
    """``(document, row, n)`` of a batch of ``document_terms``, sorted by document: the embedded fields taken together."""
    fields = batch.column("fields")
    document = np.repeat(np.arange(batch.num_rows), fields.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    entries = fields.flatten()
    used = np.isin(np.array(entries.field("field").to_pylist(), dtype=object), EMBEDDED_FIELDS)
    lists = entries.field("terms")
    entry = np.repeat(np.arange(len(entries)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    found = lists.flatten()
    words = found.field("value").dictionary_encode()
    row = np.array([term_row(w, rows) for w in words.dictionary.to_pylist()], dtype=np.int64)
    at = np.flatnonzero(used[entry]) if len(entry) else entry
    key = document[entry[at]] * rows + row[words.indices.to_numpy(zero_copy_only=False)[at]] if len(at) else at
    key, back = np.unique(key, return_inverse=True)
    n = np.bincount(back, weights=found.field("n").to_numpy(zero_copy_only=False)[at]) if len(at) else np.zeros(0)
    return key // rows, key % rows, n


def _weights(document, row, n, idf) -> np.ndarray:
    """Damped counts times rarity, with documents of length one."""
    weight = (1 + np.log(np.maximum(n, 1))) * idf[row]
    square = np.bincount(document, weights=weight * weight)
    return weight / np.sqrt(np.where(square > 0, square, 1))[document] if len(weight) else weight


def _summed(partial: DataFrame, width: int, rows: int) -> np.ndarray:
    """The table whose lines were sent on by tasks; no more lines than ``rows``."""
    added = F.array(*(F.sum(F.element_at("sums", i + 1)) for i in range(width)))
    out = np.zeros((rows, width))
    for r in partial.groupBy("line").agg(added.alias("sums")).toLocalIterator():
        out[r["line"]] = r["sums"]
    return out


def _lines(total: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(total.any(axis=1))
    edges = pa.array(np.arange(0, len(at) * total.shape[1] + 1, total.shape[1], dtype=np.int32))
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.ListArray.from_arrays(edges, pa.array(total[at].ravel()))], ["line", "sums"])


def _products(document, row, weight, table: np.ndarray, documents: int) -> np.ndarray:
    """For each document the weighted sum of the table's lines of its terms."""
    out = np.zeros((documents, table.shape[1]))
    for a in range(0, len(row), AT_ONCE):
        d, r, w = (x[a : a + AT_ONCE] for x in (document, row, weight))
        starts = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
        out[d[starts]] += np.add.reduceat(table[r] * w[:, None], starts, axis=0)
    return out


def _units(vectors: np.ndarray) -> np.ndarray:
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    return (vectors / np.where(norms > 0, norms, 1)[:, None]).astype(np.float32)


def learn_encoder(terms: DataFrame, rank: int = RANK, rows: int = ROWS, rounds: int = ROUNDS, more: int = MORE, seed: int = 3):
    """An encoder (see ``functions.encoders``) from all documents of a staged ``document_terms`` table.

    A text without a known term has the zero vector. Without documents every text has.
    """
    width = min(rank + more, rows)

    def frequencies(batches):
        total = np.zeros((rows, 1))
        documents = 0
        for batch in batches:
            total[:, 0] += np.bincount(_counts(batch, rows)[1], minlength=rows)
            documents += batch.num_rows
        yield _lines(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([[float(documents)]], pa.list_(pa.float64()))], ["line", "sums"])

    found = terms.select("fields").mapInArrow(frequencies, "line int, sums array<double>").groupBy("line").agg(F.sum(F.element_at("sums", 1)).alias("n"))
    df = np.zeros(rows)
    documents = 0.0
    for r in found.collect():
        if r["line"] < 0:
            documents = r["n"]
        else:
            df[r["line"]] = r["n"]
    idf = np.where(df > 0, np.log((1 + documents) / (1 + df)) + 1, 0.0)

    def squared(table):
        """The task function that adds up ``A' A table``."""

        def run(batches):
            total = np.zeros((rows, width))
            for batch in batches:
                document, row, n = _counts(batch, rows)
                weight = _weights(document, row, n, idf)
                near = _products(document, row, weight, table, batch.num_rows)
                order = np.argsort(row, kind="stable")
                for a in range(0, len(order), AT_ONCE):
                    o = order[a : a + AT_ONCE]
                    starts = np.flatnonzero(np.concatenate(([True], np.diff(row[o]) != 0)))
                    total[row[o][starts]] += np.add.reduceat(near[document[o]] * weight[o][:, None], starts, axis=0)
            yield _lines(total)

        return run

    table = np.linalg.qr(np.random.default_rng(seed).standard_normal((rows, width)))[0]
    core = np.zeros((width, width))
    for _ in range(rounds):
        summed = _summed(terms.select("fields").mapInArrow(squared(table), "line int, sums array<double>"), width, rows)
        core = table.T @ summed
        directions = table
        table = np.linalg.qr(summed)[0]
    values, axes = np.linalg.eigh((core + core.T) / 2)
    best = np.argsort(-values)[: min(rank, width)]
    projection = (directions @ axes[:, best]).astype(np.float32)

    def of_terms(table_of_terms: DataFrame) -> DataFrame:
        def run(batches):
            for batch in batches:
                document, row, n = _counts(batch, rows)
                vectors = _units(_products(document, row, _weights(document, row, n, idf), projection, batch.num_rows))
                edges = pa.array(np.arange(0, vectors.size + 1, vectors.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(edges, pa.array(vectors.ravel()))], ["id", "embedding"])

        return table_of_terms.select("doc_id", "fields").mapInArrow(run, "id string, embedding array<float>")

    @pandas_udf("array<float>")
    def of_tokens(tokens):
        import pandas as pd

        found = []
        for words in tokens:
            row, n = np.unique(np.array([term_row(w, rows) for w in words], dtype=np.int64), return_counts=True)
            document = np.zeros(len(row), dtype=np.int64)
            found.append(_units(_products(document, row, _weights(document, row, n, idf), projection, 1))[0])
        return pd.Series(found)

    def encode(text: Column) -> Column:
        return of_tokens(tokenize(F.coalesce(text, F.lit(""))))

    encode.of_terms = of_terms
    return encode
