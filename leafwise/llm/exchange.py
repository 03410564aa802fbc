"""Corpus-wide questions about words of chunks of documents.

Documents are read once into chunks of a few megabytes, which are written compressed.
A chunk sends one message per bucket of hashes with what it knows of each distinct
hash; the bucket answers every message, in its order, and the answers meet the chunk
again. A hash that occurs in every document is in one message per chunk, so no bucket
holds more than (chunks) entries of it, and no answer has to name what it is about.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwise.llm.words import as_bytes, slices
from leafwise.plans.staging import stage

CHUNK_BYTES = 4 << 20
#: Bytes of text for each bucket.
BUCKET_BYTES = 4 << 20


def chunked(documents: DataFrame, id_column: str, text_column: str, flag: Column | None = None, chunk_bytes: int = CHUNK_BYTES, level: int = 1) -> DataFrame:
    """Staged ``chunk, ids, flags, data, raw``: documents in order of reading, null text as empty.

    A longer text is a chunk of its own. Ids are integers. ``level``: of compression.
    """
    flag = F.lit(True) if flag is None else F.coalesce(flag, F.lit(False))
    chosen = documents.select(F.col(f"`{id_column}`").cast("long").alias("id"), flag.alias("flag"), F.col(f"`{text_column}`").alias("text"))

    def cut(batches):
        number, codec = TaskContext.get().partitionId() << 32, pa.Codec("zstd", compression_level=level)
        for batch in batches:
            texts = as_bytes(batch.column(2))
            for a, b in slices(texts, chunk_bytes):
                data = np.array([len(t) for t in texts[a:b]], dtype="<i8").tobytes() + b"".join(texts[a:b])
                packed = codec.compress(data, asbytes=True)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()),
                        pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())),
                        pa.array([part.column(1).to_pylist()], pa.list_(pa.bool_())),
                        pa.array([packed], pa.binary()),
                        pa.array([len(data)], pa.int64()),
                    ],
                    ["chunk", "ids", "flags", "data", "raw"],
                )
                number += 1

    return stage(chosen.mapInArrow(cut, "chunk long, ids array<long>, flags array<boolean>, data binary, raw long"), "chunks")


def texts_of(ids: list, data: bytes, raw: int) -> list[bytes]:
    plain = pa.decompress(data, decompressed_size=raw, codec="zstd", asbytes=True)
    sizes = np.frombuffer(plain, dtype="<i8", count=len(ids))
    ends = (8 * len(ids) + np.cumsum(sizes)).tolist()
    return [plain[a:b] for a, b in zip([8 * len(ids), *ends], ends)]


def bucket_bits(chunks: DataFrame) -> int:
    """Binary logarithm of the number of buckets, from the size of the corpus."""
    total = chunks.agg(F.sum("raw")).first()[0] or 0
    return max(3, (total // BUCKET_BYTES).bit_length())


def with_answers(chunks: DataFrame, *answers: DataFrame) -> DataFrame:
    """Chunks and their answers (``chunk, bucket, data``), each chunk's rows together, by kind and bucket."""
    none = lambda kind: F.lit(None).cast(kind)
    rows = chunks.select("chunk", F.lit(0).alias("kind"), F.lit(-1).alias("bucket"), "ids", "flags", "data", "raw")
    for kind, answer in enumerate(answers, 1):
        rows = rows.unionByName(
            answer.select(
                "chunk", F.lit(kind).alias("kind"), "bucket", none("array<long>").alias("ids"), none("array<boolean>").alias("flags"), "data", none("long").alias("raw")
            )
        )
    return rows.repartition("chunk").sortWithinPartitions("chunk", "kind", "bucket")


def bits_of(messages: list[bytes], sizes: list[int]) -> np.ndarray:
    """One array of the packed bits of several answers, of ``sizes`` bits each."""
    parts = [np.unpackbits(np.frombuffer(m, dtype=np.uint8), count=n) for m, n in zip(messages, sizes)]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, dtype=bool)


def cuts(buckets: np.ndarray) -> list[tuple[int, int, int]]:
    """``(bucket, begin, end)`` of the runs of sorted bucket numbers."""
    if not len(buckets):
        return []
    edges = np.flatnonzero(np.diff(buckets)) + 1
    begins = np.concatenate(([0], edges))
    ends = np.concatenate((edges, [len(buckets)]))
    return list(zip(buckets[begins].tolist(), begins.tolist(), ends.tolist()))
