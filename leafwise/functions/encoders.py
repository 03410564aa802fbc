"""Encoders: functions from a text column to an ``array<float>`` column.

An encoder may also have ``of_terms``, a function from term counts of documents (see
``operators.indexing.document_terms``) to their vectors, for texts tokenised already.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwise.functions.arrays import bucket_counts, let
from leafwise.functions.text import tokenize
from leafwise.schema import EMBEDDED_FIELDS

HASH_DIM = 64


def token_bucket(token: Column, dim: int) -> Column:
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint") % dim


def hash_encoder(dim: int = HASH_DIM):
    """Deterministic lexical encoder: hashed token counts, scaled to length one.

    It finds shared words, not shared meaning. A text without tokens gets the
    zero vector, which has no cosine with anything.
    """

    def encode(text: Column) -> Column:
        buckets = F.transform(tokenize(F.coalesce(text, F.lit(""))), lambda t: token_bucket(t, dim))
        return let(
            bucket_counts(buckets, dim),
            lambda counts: let(
                F.sqrt(F.aggregate(counts, F.lit(0.0), lambda acc, n: acc + n * n)),
                lambda norm: F.transform(
                    counts, lambda n: F.when(norm > 0, n / norm).otherwise(F.lit(0.0)).cast("float")
                ),
            ),
        )

    encode.of_terms = lambda terms: _hashed_terms(terms, dim)
    return encode


def _hashed_terms(terms: DataFrame, dim: int) -> DataFrame:
    """``(id, embedding)``: what ``hash_encoder`` makes of a document's text, from its term counts.

    A word is hashed once for each batch of documents, however often it occurs.
    """
    kept = EMBEDDED_FIELDS

    def run(batches):
        for batch in batches:
            fields = batch.column(1)
            document = np.repeat(np.arange(batch.num_rows), fields.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            entries = fields.flatten()
            used = np.isin(np.array(entries.field("field").to_pylist(), dtype=object), kept)
            lists = entries.field("terms")
            entry = np.repeat(np.arange(len(entries)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            found = lists.flatten()
            words = found.field("value").dictionary_encode()
            bucket = np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim for w in words.dictionary.to_pylist()], dtype=np.int64)
            at = np.flatnonzero(used[entry]) if len(entry) else entry
            cell = document[entry[at]] * dim + bucket[words.indices.to_numpy(zero_copy_only=False)[at]] if len(at) else at
            counts = np.bincount(cell, weights=found.field("n").to_numpy(zero_copy_only=False)[at], minlength=batch.num_rows * dim)
            counts = counts.reshape(-1, dim)
            norms = np.sqrt((counts * counts).sum(axis=1))
            vectors = (counts / np.where(norms > 0, norms, 1)[:, None]).astype(np.float32)
            edges = pa.array(np.arange(0, vectors.size + 1, dim, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(edges, pa.array(vectors.ravel()))], ["id", "embedding"])

    return terms.select("doc_id", "fields").mapInArrow(run, "id string, embedding array<float>")


def model_encoder(make_predict_fn, batch_size: int = 64):
    """Encoder around a user's model.

    ``make_predict_fn`` loads the model once per Python worker and returns a
    function from a NumPy array of texts to a two-dimensional float array.
    """
    from pyspark.ml.functions import predict_batch_udf

    return predict_batch_udf(
        make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size
    )
