"""Term statistics and vectors of a document table."""

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwise.functions.text import tokenize
from leafwise.operators.parsing import embedding_text
from leafwise.plans.groups import giving_back
from leafwise.schema import EMBEDDED_FIELDS, FIELDS

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # for executors without this package

#: Tokens that a task counts at a time; a longer document is taken whole.
TOKENS_AT_ONCE = 1 << 20


def _field_text(field, data_type):
    # A newline is no token character, so joining keeps list elements apart.
    column = F.array_join(field, "\n") if data_type == "array" else F.col(field)
    return F.coalesce(column, F.lit(""))


def _counted(rows: pa.RecordBatch, fields) -> pa.RecordBatch:
    """``document_terms`` of rows with a document's id and its tokens by field."""
    lists = rows.columns[1:]
    sizes = np.stack([c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for c in lists], axis=1).astype(np.int64)
    tokens = pa.concat_arrays([c.flatten() for c in lists]).dictionary_encode()
    order = pc.sort_indices(tokens.dictionary)
    words = tokens.dictionary.take(order)
    rank = np.empty(len(words), dtype=np.int64)
    rank[order.to_numpy()] = np.arange(len(words))
    entry = np.arange(sizes.size).reshape(sizes.shape)  # one for each field of each document
    key = np.repeat(entry.T.ravel(), sizes.T.ravel()) * max(1, len(words)) + rank[tokens.indices.to_numpy(zero_copy_only=False)]
    key.sort()
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), dtype=bool), key[1:] != key[:-1])))
    n = np.diff(np.append(starts, len(key))).astype(np.int32)
    of, word = np.divmod(key[starts], max(1, len(words)))
    full = np.flatnonzero(sizes.ravel())
    edges = lambda counts: pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
    terms = pa.StructArray.from_arrays([words.take(pa.array(word)), pa.array(n)], ["value", "n"])
    each = pa.StructArray.from_arrays(
        [
            pa.array(np.array(fields, dtype=object)[full % len(fields)], pa.string()),
            pa.array(sizes.ravel()[full]),
            pa.ListArray.from_arrays(edges(np.bincount(of, minlength=sizes.size)[full]), terms),
        ],
        ["field", "dl", "terms"],
    )
    return pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(edges((sizes > 0).sum(axis=1)), each)], ["doc_id", "fields"])


def document_terms(documents: DataFrame, fields=FIELDS) -> DataFrame:
    """``(doc_id, fields)`` per document: of each non-empty field ``(field, dl, terms)``; narrow, no shuffle."""
    types = {f.name: f.dataType.typeName() for f in documents.schema}
    names = list(fields)
    tokens = documents.select(F.col("id").alias("doc_id"), *[tokenize(_field_text(f, types[f])).alias(f) for f in names])
    kind = documents.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            total = np.cumsum(sum(c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[1:]))
            begin = 0
            while begin < batch.num_rows:
                before = total[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(total, before + TOKENS_AT_ONCE, side="right")))
                yield _counted(batch.slice(begin, end - begin), names)
                begin = end

    schema = f"doc_id {kind}, fields array<struct<field:string,dl:bigint,terms:array<struct<value:string,n:int>>>>"
    return tokens.mapInArrow(lambda batches: giving_back(run(batches)), schema)


def by_field(terms: DataFrame) -> DataFrame:
    """``(field, doc_id, dl, terms)``: a row per field of ``document_terms``."""
    return terms.select("doc_id", F.explode("fields").alias("f")).select("f.field", "doc_id", "f.dl", "f.terms")


def field_terms(documents: DataFrame, fields=FIELDS) -> DataFrame:
    """``(field, doc_id, dl, terms)`` per non-empty field; narrow, no shuffle."""
    return by_field(document_terms(documents, fields))


def postings_of(terms: DataFrame) -> DataFrame:
    return terms.select("field", "doc_id", "dl", F.explode("terms").alias("t")).select(
        "field",
        F.col("t.value").alias("term"),
        "doc_id",
        F.col("t.n").cast("bigint").alias("tf"),
        "dl",
    )


def build_postings(documents: DataFrame, fields=FIELDS) -> DataFrame:
    """One row per distinct term of a document field.

    ``documents`` has one row per id. Terms are counted inside the row, so the
    largest table of the index is made without a shuffle.
    """
    return postings_of(field_terms(documents, fields))


def term_stats(postings: DataFrame) -> DataFrame:
    """Document frequency per term and field; counted map-side first."""
    return postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))


def field_stats(postings: DataFrame) -> DataFrame:
    """Documents with a token in the field, and their mean length."""
    return field_stats_of(postings.select("field", "doc_id", "dl").distinct())


def field_stats_of(terms: DataFrame) -> DataFrame:
    """The same from one row per document field: no distinct, a handful of rows shuffled."""
    return terms.groupBy("field").agg(
        F.count(F.lit(1)).alias("n_docs"),
        (F.sum("dl") / F.count(F.lit(1))).alias("avgdl"),
    )


def embed_documents(documents: DataFrame, encoder, terms: DataFrame | None = None) -> DataFrame:
    """``(id, embedding)``; from term counts if the encoder can, those in ``terms`` if they are there already."""
    if hasattr(encoder, "of_terms"):
        return encoder.of_terms(document_terms(documents, EMBEDDED_FIELDS) if terms is None else terms)
    return documents.select("id", encoder(embedding_text()).alias("embedding"))
