"""Exact substring dedup with difference-cover anchors.

A passage counts when ``LENGTH`` words in a row occur in two documents. Take a set of
places modulo a period (a difference cover) such that any two places differ by some
pair of the set. If two documents share a passage, then some shift below the period
brings both its starts to cover places at once. So short windows hashed at cover
places only, of ``LENGTH - PERIOD + 1`` words, are enough: every passage holds one
that both documents have hashed. Anchors that a second document has too are looked at
again, and the passages around them are extended to full length and compared exactly.

Anchors and passages are exchanged by buckets of their hashes (see ``exchange``):
four bytes per anchor go out, one bit comes back.
"""

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwise.llm import exchange
from leafwise.llm.words import U64, hash_windows, hash_words, sorted_groups, split_words, window_starts
from leafwise.plans.staging import stage

#: Words of a passage.
LENGTH = 13
#: A perfect difference cover: every remainder modulo 7 is a difference of two of its places.
PERIOD, COVER = 7, (0, 1, 3)
LAST = np.iinfo(np.int64).max


def _anchors(words, hashes, length: int, bits: int):
    """Words at which anchors start, their sorted distinct keys, and each anchor's key number."""
    width = length - PERIOD + 1
    starts = window_starts(words, width)
    starts = starts[np.isin(words.places()[starts] % PERIOD, COVER)]
    key = hash_windows(hashes, starts, width) >> U64(32 - bits)
    keys, number = np.unique(key, return_inverse=True)
    return starts, keys, number


def _passages(words, hashes, starts, ids, length: int, bits: int):
    """Order of the passages by bucket and hash, where distinct ones begin in it, and what to send of them."""
    first = hash_windows(hashes, starts, length, seed=1000)
    bucket = (hash_windows(hashes, starts, length, seed=2000) >> U64(64 - bits)).astype(np.int64)
    order = np.lexsort((first, bucket))
    first, bucket = first[order], bucket[order]
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (first[1:] != first[:-1]) | (bucket[1:] != bucket[:-1])
    begins = np.flatnonzero(fresh)
    own = ids[words.text_of()[starts[order]]]
    least = np.minimum.reduceat(own, begins) if len(begins) else own
    return order, begins, first[begins], bucket[begins], least, own


def _candidates(words, hashes, length, shared_starts):
    """Full windows that hold one of the shared anchors."""
    starts = window_starts(words, length)
    mark = np.zeros(len(hashes) + 1, dtype=np.int64)
    mark[shared_starts + 1] = 1
    mark = np.cumsum(mark)
    return starts, mark[starts + PERIOD] > mark[starts]


def _read(group):
    """Ids (null is greatest), texts, words and hashes of the chunk that heads a group."""
    ids, data, raw = (group.column(c)[0].as_py() for c in ("ids", "data", "raw"))
    texts = exchange.texts_of(ids, data, raw)
    words = split_words(texts)
    return ids, np.array([LAST if i is None else i for i in ids], dtype=np.int64), texts, words, hash_words(words)


def remove_repeated_passages(
    documents: DataFrame,
    length: int = LENGTH,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_text: bool = False,
    chunk_bytes: int = exchange.CHUNK_BYTES,
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256[, kept_text]`` of every row of ``documents``.

    A word is removed when a window of ``length`` words covers it whose word sequence
    also starts in a document with a smaller id. Windows are judged on the input. Rows
    with one id do not affect each other; a null id is greater than any other. A null
    text has no words; an empty table gives no rows. Ids are integers. Other columns
    are left out.
    """
    if length <= PERIOD:
        raise ValueError(f"passages need more than {PERIOD} words")
    chunks = exchange.chunked(documents, id_column, text_column, chunk_bytes=chunk_bytes, level=6)
    bits = exchange.bucket_bits(chunks)

    def send_anchors(batches):
        for _, group in sorted_groups(batches, ["chunk"]):
            _, _, _, words, hashes = _read(group)
            starts, keys, number = _anchors(words, hashes, length, bits)
            text = words.text_of()[starts]
            low, high = np.full(len(keys), LAST), np.full(len(keys), -1)
            np.minimum.at(low, number, text)
            np.maximum.at(high, number, text)
            several = low != high
            runs = exchange.cuts((keys >> U64(32)).astype(np.int64))
            small = (keys & U64(0xFFFFFFFF)).astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([group.column("chunk")[0].as_py()] * len(runs), pa.int64()),
                    pa.array([r[0] for r in runs], pa.int32()),
                    pa.array([small[a:b].tobytes() for _, a, b in runs], pa.binary()),
                    pa.array([np.packbits(several[a:b]).tobytes() for _, a, b in runs], pa.binary()),
                ],
                ["chunk", "bucket", "data", "several"],
            )

    def answer_anchors(table):
        parts = [np.frombuffer(x, dtype="<u4") for x in table.column("data").to_pylist()]
        sizes = [len(p) for p in parts]
        keys = np.concatenate(parts)
        several = exchange.bits_of(table.column("several").to_pylist(), sizes)
        _, number, count = np.unique(keys, return_inverse=True, return_counts=True)
        shared = (count > 1) | (np.bincount(number, several) > 0)
        return _bits_back(table, shared[number], sizes)

    def send_passages(batches):
        for _, group in sorted_groups(batches, ["chunk"]):
            _, ids, _, words, hashes = _read(group)
            starts, keys, number = _anchors(words, hashes, length, bits)
            runs = exchange.cuts((keys >> U64(32)).astype(np.int64))
            shared = exchange.bits_of(group.column("data").to_pylist()[1:], [b - a for _, a, b in runs])
            windows, chosen = _candidates(words, hashes, length, starts[shared[number]] if len(starts) else starts)
            _, _, first, bucket, least, _ = _passages(words, hashes, windows[chosen], ids, length, bits)
            runs = exchange.cuts(bucket)
            chosen = pa.compress(np.packbits(chosen).tobytes() or b"\0", codec="zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([group.column("chunk")[0].as_py()] * (len(runs) + 1), pa.int64()),
                    pa.array([-1, *(r[0] for r in runs)], pa.int32()),
                    pa.array([chosen, *(first[a:b].astype("<u8").tobytes() for _, a, b in runs)], pa.binary()),
                    pa.array([None, *(least[a:b].astype("<i8").tobytes() for _, a, b in runs)], pa.binary()),
                ],
                ["chunk", "bucket", "data", "least"],
            )

    def answer_passages(table):
        parts = [np.frombuffer(x, dtype="<u8") for x in table.column("data").to_pylist()]
        own = np.concatenate([np.frombuffer(x, dtype="<i8") for x in table.column("least").to_pylist()])
        keys, number = np.unique(np.concatenate(parts), return_inverse=True)
        least = np.full(len(keys), LAST)
        np.minimum.at(least, number, own)
        return _bits_back(table, least[number] < own, [len(p) for p in parts])

    def remove(batches):
        for _, group in sorted_groups(batches, ["chunk"]):
            names, ids, texts, words, hashes = _read(group)
            kinds, data = group.column("kind").to_pylist(), group.column("data").to_pylist()
            windows = window_starts(words, length)
            packed = pa.decompress(data[1], decompressed_size=max(1, -(-len(windows) // 8)), codec="zstd", asbytes=True)
            chosen = np.unpackbits(np.frombuffer(packed, dtype=np.uint8), count=len(windows)).astype(bool)
            starts = windows[chosen]
            order, begins, first, bucket, least, own = _passages(words, hashes, starts, ids, length, bits)
            runs = exchange.cuts(bucket)
            earlier = exchange.bits_of([d for k, d in zip(kinds, data) if k == 2], [b - a for _, a, b in runs])
            sizes = np.diff(np.concatenate((begins, [len(order)])))
            gone = np.repeat(earlier, sizes) | (own > np.repeat(least, sizes)) if len(order) else np.zeros(0, dtype=bool)
            depth = np.zeros(len(hashes) + 1, dtype=np.int64)
            np.add.at(depth, starts[order][gone], 1)
            np.add.at(depth, starts[order][gone] + length, -1)
            kept = np.cumsum(depth[:-1]) == 0
            totals = np.concatenate(([0], np.cumsum(~kept)))
            removed = totals[words.first[1:]] - totals[words.first[:-1]]
            joined = []
            for i, text in enumerate(texts):
                own_words = text.split()
                if removed[i]:
                    own_words = compress(own_words, kept[words.first[i] : words.first[i + 1]].tolist())
                joined.append(b" ".join(own_words))
            columns = [
                pa.array(names, pa.int64()),
                pa.array(words.counts.astype(np.int64)),
                pa.array(removed.astype(np.int64)),
                pa.array([hashlib.sha256(j).hexdigest() for j in joined]),
            ]
            if with_text:
                columns.append(pa.array([j.decode() for j in joined], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: len(columns)])

    answered = "chunk long, bucket int, data binary"
    anchors = stage(chunks.mapInArrow(send_anchors, f"{answered}, several binary"), "anchors")
    shared = stage(anchors.groupBy("bucket").applyInArrow(answer_anchors, answered), "shared_anchors")
    passages = stage(exchange.with_answers(chunks, shared).mapInArrow(send_passages, f"{answered}, least binary"), "passages")
    marks = passages.filter("bucket < 0").select("chunk", "bucket", "data")
    seen = passages.filter("bucket >= 0").groupBy("bucket").applyInArrow(answer_passages, answered)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return exchange.with_answers(chunks, marks, seen).mapInArrow(remove, schema)


def _bits_back(table: pa.Table, bits: np.ndarray, sizes: list[int]) -> pa.Table:
    ends = np.cumsum(sizes).tolist()
    packed = [np.packbits(bits[a:b]).tobytes() for a, b in zip([0, *ends], ends)]
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "data": pa.array(packed, pa.binary())})
