"""Words of many texts at once, as NumPy arrays inside a task.

Texts are UTF-8 bytes joined by a line feed, which is a separator in every word
rule used here. A word is a run of bytes that are no separators; as the separators
are ASCII, runs of bytes and runs of code points are the same.
"""

import ctypes
import gc
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK = 1 << 20
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _separators(ranges) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: White space of the rule ``[^\x20\x09-\x0D]+``.
SPACES = _separators([(0x09, 0x0D), (0x20, 0x20)])
#: Separators of the rule ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
NOT_ALNUM = _separators([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])

_BYTES = mix(np.arange(1, 257, dtype=U64))


@dataclass
class Words:
    """``starts``/``ends``: byte places in ``data``; ``first[d]``: first word of text ``d``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """For each word the number of its text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def places(self) -> np.ndarray:
        """For each word its place in its text, from 0."""
        return np.arange(len(self.starts)) - np.repeat(self.first[:-1], self.counts)


def split_words(texts: list[bytes], separators: np.ndarray = SPACES, lower: bool = False) -> Words:
    joined = b"\n".join(texts) + b"\n"
    if lower:
        joined = joined.lower()  # of bytes: A-Z only
    data = np.frombuffer(joined, dtype=np.uint8)
    gap = np.concatenate(([True], separators[data]))
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edges[0::2], edges[1::2]
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    return Words(data, starts, ends, np.searchsorted(starts, bounds))


def hash_words(words: Words, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word, in blocks so that memory stays bounded."""
    out = np.empty(len(words.starts), dtype=U64)
    table = _BYTES if not seed else mix(_BYTES + U64(seed))
    power, inverse = np.empty(0, dtype=U64), np.empty(0, dtype=U64)
    a = 0
    while a < len(out):
        origin = words.starts[a]
        b = max(a + 1, int(np.searchsorted(words.ends, origin + BLOCK, side="right")))
        size = int(words.ends[b - 1] - origin)
        if len(power) < size + 1:
            power = np.cumprod(np.concatenate(([U64(1)], np.full(size, _BASE))), dtype=U64)
            inverse = np.cumprod(np.concatenate(([U64(1)], np.full(size, _INVERSE))), dtype=U64)
        total = np.zeros(size + 1, dtype=U64)
        np.cumsum(table[words.data[origin : origin + size]] * power[:size], out=total[1:])
        s, e = words.starts[a:b] - origin, words.ends[a:b] - origin
        out[a:b] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(U64))
        a = b
    return out


def hash_windows(hashes: np.ndarray, starts: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hashes of ``width`` consecutive word hashes from each of ``starts``."""
    factors = mix(np.arange(1 + seed, 1 + seed + width, dtype=U64)) | U64(1)
    out = np.zeros(len(starts), dtype=U64)
    for k in range(width):
        out += hashes[starts + k] * factors[k]
    return mix(out)


def window_starts(words: Words, width: int) -> np.ndarray:
    """The words at which a window of ``width`` words of one text starts."""
    counts = np.maximum(words.counts - width + 1, 0)
    shift = np.repeat(words.first[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return np.arange(counts.sum()) + shift


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def released(run):
    """A task function that gives back what it has freed when it ends.

    Python workers are used again by the tasks after it, of any operator, and would
    keep the memory that the largest of them needed.
    """

    def task(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
        if trim:
            trim(0)

    return task


def slices(texts: list[bytes], limit: int = 4 << 20):
    """Ranges of consecutive texts of about ``limit`` bytes; a longer text is its own range."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if i > begin and size + len(text) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def sorted_groups(batches, keys: list[str]):
    """``(key, table)`` for each run of rows with equal keys, across batch borders.

    The rows must come sorted by the keys. No more than one group is held.
    """
    held, held_key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = list(zip(*(batch.column(k).to_pylist() for k in keys)))
        begin = 0
        for i in range(1, len(rows) + 1):
            if i < len(rows) and rows[i] == rows[begin]:
                continue
            if held and rows[begin] != held_key:
                yield held_key, pa.Table.from_batches(held)
                held = []
            held_key = rows[begin]
            held.append(batch.slice(begin, i - begin))
            begin = i
    if held:
        yield held_key, pa.Table.from_batches(held)
