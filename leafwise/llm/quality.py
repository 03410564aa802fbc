"""Quality rules on repetition, by suffix arrays.

Each text's suffixes, taken by words, are sorted; neighbours in that order share the
longest prefixes. Where the shared prefix has ``WINDOW`` words or more, a repeated
substring begins; the longest one at each word, from its two neighbours, is maximal.
The union of these spans is what repeats, the longest of them the longest repeat.

Only words inside windows of ``WINDOW`` words that occur twice can be part of a
repeat, so the suffix array is built over those, by doubling prefixes; in most texts
they are few. The base rule counts the words in those windows; the method's fraction
is that of the union of the spans.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwise.llm.words import U64, as_bytes, hash_windows, hash_words, mix, slices, split_words, window_starts

#: Words of the shortest repeat.
WINDOW = 8
#: Base rule: fewest words, highest percentage of repeated words.
MIN_WORDS, MAX_REPEATED_PERCENT = 20, 30
#: The method's limits: covered percentage and words of the longest repeat.
MAX_COVERED_PERCENT, MAX_LONGEST = 30, 200
_SYMBOLS = b"#*$%&|<>"
_NOT_WORD_CHARS = b" \t\n\v\f\r" + bytes(range(0x80, 0xC0))


def repeats(words, hashes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For each word the length of the longest repeat that starts there, and whether a repeated window covers it.

    Positions are those of all texts together; a repeat lies within one text.
    """
    length = np.zeros(len(hashes), dtype=np.int64)
    covered = np.zeros(len(hashes), dtype=bool)
    starts = window_starts(words, window)
    if not len(starts):
        return length, covered
    text = words.text_of()
    key = mix(hash_windows(hashes, starts, window) ^ mix(text[starts].astype(U64) + U64(1)))
    order = np.argsort(key, kind="stable")
    key, suffix = key[order], starts[order]
    same = key[1:] == key[:-1]
    in_class = np.concatenate((same, [False])) | np.concatenate(([False], same))
    if not in_class.any():
        return length, covered
    depth = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(depth, suffix[in_class], 1)
    np.add.at(depth, suffix[in_class] + window, -1)
    covered = np.cumsum(depth[:-1]) > 0
    # a repeat lies within one run of covered words, as all its windows are repeated
    at = np.flatnonzero(covered)
    breaks = np.flatnonzero((np.diff(at) > 1) | (np.diff(text[at]) > 0)) + 1
    ends = np.concatenate((breaks, [len(at)]))
    end = np.repeat(ends, np.diff(np.concatenate(([0], ends))))
    here = np.arange(len(at))
    rank = np.unique(mix(hashes[at] ^ mix(text[at].astype(U64) + U64(1))), return_inverse=True)[1]
    step, longest = 1, int((end - here).max())
    while step < longest and rank.max() < len(at) - 1:  # order by twice as many words each time
        later = np.where(here + step < end, rank[np.minimum(here + step, len(at) - 1)] + 1, 0)
        rank = np.unique(rank * (len(at) + 2) + later, return_inverse=True)[1]
        step *= 2
    order = np.argsort(rank, kind="stable")
    left, right = order[:-1], order[1:]
    most = np.where(text[at[left]] == text[at[right]], np.minimum(end[left] - left, end[right] - right), 0)
    shared = _shared_prefix(Spans(hashes), at[left], at[right], most)
    np.maximum.at(length, at[left], shared)
    np.maximum.at(length, at[right], shared)
    length[length < window] = 0
    return length, covered


def covered_by(length: np.ndarray) -> np.ndarray:
    """Whether each word lies in one of the repeats that start at the words and have these lengths."""
    at = np.arange(len(length))
    ends = np.maximum.accumulate(at + length) if len(length) else at
    return ends > at


class Spans:
    """Hashes of any span of words, from sums made once."""

    base = 0xD1342543DE82EF95

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        power = np.cumprod(np.concatenate(([U64(1)], np.full(n, U64(self.base)))), dtype=U64)
        self.back = np.cumprod(np.concatenate(([U64(1)], np.full(n, U64(pow(self.base, -1, 1 << 64))))), dtype=U64)
        self.total = np.concatenate(([U64(0)], np.cumsum(hashes * power[:-1], dtype=U64)))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the words from ``a`` to before ``b``."""
        return mix((self.total[b] - self.total[a]) * self.back[a] + (b - a).astype(U64)) | U64(1)


def _shared_prefix(spans, left, right, most) -> np.ndarray:
    """Words that the suffixes at ``left`` and ``right`` share, ``most`` at most, by halving steps."""
    shared = np.zeros(len(left), dtype=np.int64)
    if not len(left):
        return shared
    step = 1 << int(most.max()).bit_length()
    while step:
        can = shared + step <= most
        if can.any():
            i = np.flatnonzero(can)
            a, b = left[i] + shared[i], right[i] + shared[i]
            equal = spans(a, a + step) == spans(b, b + step)
            shared[i[equal]] += step
        step //= 2
    return shared


def quality_rules(
    documents: DataFrame,
    max_covered_percent: int = MAX_COVERED_PERCENT,
    max_longest: int = MAX_LONGEST,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Counts, the base rule and the verdict of every row of ``documents``.

    ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, longest_repeat``. A text fails the method when the spans of shared prefixes cover more than
    ``max_covered_percent`` of its words or the longest has more than ``max_longest``
    words. A null or blank text has no words and fails the base rule. Rows that repeat
    are judged alike; an empty table gives no rows. Other columns are left out.
    """
    kind = documents.schema[id_column].dataType.simpleString()

    def judge(batches):
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for a, b in slices(texts, 2 << 20):
                own = texts[a:b]
                words = split_words(own)
                hashes = hash_words(words)
                length, covered = repeats(words, hashes)
                n = words.counts
                totals = np.concatenate(([0], np.cumsum(covered)))
                n_repeat = totals[words.first[1:]] - totals[words.first[:-1]]
                totals = np.concatenate(([0], np.cumsum(covered_by(length))))
                n_covered = totals[words.first[1:]] - totals[words.first[:-1]]
                longest = np.zeros(len(own), dtype=np.int64)
                np.maximum.at(longest, words.text_of(), length)
                chars = [len(t.translate(None, _NOT_WORD_CHARS)) for t in own]
                symbols = [len(t) - len(t.translate(None, _SYMBOLS)) for t in own]
                lines = [[x for x in t.split(b"\n") if x and not x.isspace()] for t in own]
                dup = [len(x) - len(set(x)) for x in lines]
                failed = (n < MIN_WORDS) | (100 * n_repeat > MAX_REPEATED_PERCENT * n)
                kept = ~failed & (100 * n_covered <= max_covered_percent * n) & (longest <= max_longest)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(n.astype(np.int64)),
                        pa.array(chars, pa.int64()),
                        pa.array(symbols, pa.int64()),
                        pa.array(dup, pa.int64()),
                        pa.array(n_repeat.astype(np.int64)),
                        pa.array(failed),
                        pa.array(kept),
                        pa.array(longest),
                    ],
                    ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "longest_repeat"],
                )

    chosen = documents.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    return chosen.mapInArrow(
        judge,
        f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, longest_repeat long",
    )
