"""Benchmark decontamination by a positional inverted index.

The terms are the words of the benchmark's windows. A first pass over the documents
counts them, so that each window knows its rarest terms. A second pass stores the index:
for documents in which some window's two rarest terms stand at the right distance, or
its three rarest come close, the postings (positions by term) of every benchmark term;
no other document can hold a window or come near one. Phrases are then found on the postings alone: the positions of a window's rarest
term, less its offset in the window, are intersected with those of the next rarest and
so on until nothing is left or the phrase is exact. Windows whose rarest terms come
close without being the phrase are proximity matches.

The benchmark is the stated query set. It is taken in blocks of bounded size, each of
which meets all documents.
"""

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwise.llm.words import NOT_ALNUM, as_bytes, hash_words, released, slices, split_words
from leafwise.plans.staging import stage

#: Words of a window.
WIDTH = 13
#: Bytes of benchmark text that one pass over the documents answers.
BLOCK_BYTES = 16 << 20
#: Bytes of text, and places of rarest terms, that a task takes at a time.
SLICE, PLACES = 1 << 18, 1 << 14
#: A proximity match: so many of the rarest terms within so many words.
NEAR_TERMS, NEAR_SPAN = 3, 26


class Queries:
    """Windows of a block of items as term numbers."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int):
        words = split_words([(t or "").encode() for _, t in items], NOT_ALNUM, lower=True)
        self.terms, number = np.unique(hash_words(words), return_inverse=True)  # without any, nothing is found
        owners: dict[tuple, set] = defaultdict(set)
        for i, (name, _) in enumerate(items):
            own = number[words.first[i] : words.first[i + 1]].tolist()
            for k in range(max(len(own) - width + 1, min(len(own), 1))):
                owners[tuple(own[k : k + width])].add(name)
        self.windows = sorted(owners)
        self.owners = [sorted(x for x in owners[w] if x is not None) for w in self.windows]
        self.order: list[list[int]] = []

    def rank(self, frequency: np.ndarray) -> None:
        """Order each window's places by how rare their terms are, and index windows by the rarest."""
        self.order = [sorted(range(len(w)), key=lambda k: (frequency[w[k]], w[k], k)) for w in self.windows]
        rarest = np.array([w[o[0]] for w, o in zip(self.windows, self.order)], dtype=np.int64)
        self.by_term = np.argsort(rarest, kind="stable")
        self.term_begin = np.searchsorted(rarest[self.by_term], np.arange(len(self.terms) + 1))
        self.size = np.array([len(w) for w in self.windows])
        self.first_place = np.array([o[0] for o in self.order], dtype=np.int64)
        self.next_place = np.array([o[min(1, len(o) - 1)] for o in self.order], dtype=np.int64)
        self.next_term = np.array([w[o[min(1, len(o) - 1)]] for w, o in zip(self.windows, self.order)], dtype=np.int64)
        self.third_term = np.array([w[o[NEAR_TERMS - 1]] if len(o) >= NEAR_TERMS else -1 for w, o in zip(self.windows, self.order)], dtype=np.int64)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Term number of each word, -1 for others."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        at = np.searchsorted(self.terms, hashes)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == hashes, at, -1)

    def promising(self, words, number: np.ndarray) -> np.ndarray:
        """The texts in which some window's two rarest terms stand as in the window, or its three rarest come close."""
        at = np.flatnonzero(number >= 0)
        n, term = len(number), number[at]
        keys = np.sort(term * n + at)
        times = self.term_begin[term + 1] - self.term_begin[term]
        at, term = at[times > 0], term[times > 0]
        text, found = words.text_of(), np.zeros(len(words.first) - 1, dtype=bool)

        def close(term, place):
            """Whether ``term`` stands in the same text fewer than ``NEAR_SPAN`` words away."""
            low = np.maximum(place - NEAR_SPAN + 1, words.first[text[place]])
            high = np.minimum(place + NEAR_SPAN, words.first[text[place] + 1])
            nearest = np.minimum(np.searchsorted(keys, term * n + low), len(keys) - 1)
            return (keys[nearest] >= term * n + low) & (keys[nearest] < term * n + high)

        for a in range(0, len(at), PLACES):  # bounded, however many windows a term has
            t = term[a : a + PLACES]
            times = self.term_begin[t + 1] - self.term_begin[t]
            ends = np.cumsum(times)
            inner = np.arange(ends[-1]) - np.repeat(ends - times, times)
            window = self.by_term[np.repeat(self.term_begin[t], times) + inner]
            place = np.repeat(at[a : a + PLACES], times)
            start, own = place - self.first_place[window], text[place]
            fits = (start >= words.first[own]) & (start + self.size[window] <= words.first[own + 1])
            other = np.where(fits, start + self.next_place[window], place)
            found[own[fits & (number[other] == self.next_term[window])]] = True
            open_ = np.flatnonzero(~found[own] & (self.third_term[window] >= 0))
            open_ = open_[close(self.next_term[window[open_]], place[open_])]
            open_ = open_[close(self.third_term[window[open_]], place[open_])]
            found[own[open_]] = True
        return found

    def matches(self, postings: dict[int, np.ndarray]):
        """``(window, starts)`` of the exact phrases, and the windows that are only near."""
        exact, near = [], []
        for term in postings:
            for w in self.by_term[self.term_begin[term] : self.term_begin[term + 1]].tolist():
                window, order = self.windows[w], self.order[w]
                starts = postings[term] - order[0]
                for k in order[1:]:
                    other = postings.get(window[k])
                    if other is None:
                        starts = starts[:0]
                    elif len(starts):
                        at = np.searchsorted(other, starts + k)
                        at[at == len(other)] = 0
                        starts = starts[other[at] == starts + k]
                    if not len(starts):
                        break
                if len(starts):
                    exact.append((w, starts))
                elif self._near([postings.get(window[k]) for k in order[:NEAR_TERMS]]):
                    near.append(w)
        return exact, near

    @staticmethod
    def _near(lists) -> bool:
        if len(lists) < NEAR_TERMS or any(x is None for x in lists):
            return False
        worst = np.zeros(len(lists[0]), dtype=np.int64)
        for other in lists[1:]:
            at = np.searchsorted(other, lists[0])
            left = np.abs(lists[0] - other[np.maximum(at - 1, 0)])
            right = np.abs(lists[0] - other[np.minimum(at, len(other) - 1)])
            worst = np.maximum(worst, np.minimum(left, right))
        return bool((worst < NEAR_SPAN).any())


def _index(rows: DataFrame, queries: Queries, with_text: bool) -> DataFrame:
    """``rows`` with ``n_words``, and ``terms, positions`` (packed, sorted by term) where a window may occur."""
    kept = [c for c in rows.columns if with_text or c != "text"]

    def build(batches):
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            for a, b in slices(texts, SLICE):
                words = split_words(texts[a:b], NOT_ALNUM, lower=True)
                number = queries.numbers(hash_words(words))
                terms, positions = [None] * (b - a), [None] * (b - a)
                for i in np.flatnonzero(queries.promising(words, number)).tolist():
                    own = number[words.first[i] : words.first[i + 1]]
                    place = np.flatnonzero(own >= 0)
                    order = np.argsort(own[place], kind="stable")
                    terms[i] = own[place][order].astype("<i4").tobytes()
                    positions[i] = place[order].astype("<i4").tobytes()
                part = batch.slice(a, b - a)
                columns = [part.column(c) for c in kept]
                columns += [pa.array(words.counts.astype(np.int64)), pa.array(terms, pa.binary()), pa.array(positions, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [*kept, "n_words", "terms", "positions"])

    return rows.mapInArrow(released(build), f"{_schema(rows.select(*kept))}, n_words long, terms binary, positions binary")


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _frequencies(rows: DataFrame, queries: Queries) -> np.ndarray:
    """Occurrences of each term in all documents; no more rows than the block has terms."""

    def count(batches):
        total = np.zeros(len(queries.terms), dtype=np.int64)
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            for a, b in slices(texts, SLICE):
                number = queries.numbers(hash_words(split_words(texts[a:b], NOT_ALNUM, lower=True)))
                total += np.bincount(number[number >= 0], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["term", "n"])

    out = np.zeros(len(queries.terms), dtype=np.int64)
    for r in rows.select("text").mapInArrow(released(count), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


FOUND = ("starts", "ends", "items", "near")
_FOUND_SCHEMA = "starts array<long>, ends array<long>, items array<string>, near array<string>"


def _search(index: DataFrame, queries: Queries, then=None, schema: str = "") -> DataFrame:
    """Add to ``starts, ends, items, near`` of each row what its postings hold; the postings go.

    ``then`` takes the batches further in the same task, to rows of ``schema``.
    """
    kept = [c for c in index.columns if c not in (*FOUND, "terms", "positions")]

    def search(batches):
        for batch in batches:
            found = [batch.column(c).to_pylist() for c in FOUND]
            for i, (terms, positions) in enumerate(zip(batch.column("terms").to_pylist(), batch.column("positions").to_pylist())):
                if terms is None:
                    continue
                terms, positions = np.frombuffer(terms, dtype="<i4"), np.frombuffer(positions, dtype="<i4").astype(np.int64)
                edges = np.concatenate(([0], np.flatnonzero(np.diff(terms)) + 1, [len(terms)]))
                postings = {int(terms[a]): positions[a:b] for a, b in zip(edges[:-1], edges[1:])}
                exact, near = queries.matches(postings)
                found[0][i] = found[0][i] + [int(s) for _, starts in exact for s in starts]
                found[1][i] = found[1][i] + [int(s) + len(queries.windows[w]) for w, starts in exact for s in starts]
                found[2][i] = found[2][i] + sorted({x for w, _ in exact for x in queries.owners[w]})
                found[3][i] = found[3][i] + sorted({x for w in near for x in queries.owners[w]})
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [batch.column(c) for c in kept] + [pa.array(f, pa.list_(k)) for f, k in zip(found, kinds)]
            yield pa.RecordBatch.from_arrays(columns, [*kept, *FOUND])

    if then is not None:
        return index.mapInArrow(released(lambda batches: then(search(batches))), schema)
    return index.mapInArrow(released(search), f"{_schema(index.select(*kept))}, {_FOUND_SCHEMA}")


def _block(items: DataFrame, blocks: int, number: int) -> list:
    chosen = items.filter(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == number)
    return [(r["name"], r["text"]) for r in chosen.collect()]


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    width: int = WIDTH,
    percent: int = 5,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    carry: tuple[str, ...] = (),
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Which documents hold windows of benchmark items, one row per document.

    ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near`` and the
    columns named in ``carry``. ``n_near``: items with a proximity match and no exact
    one. Contaminated: some word is hit, and ``percent`` per cent of the words or more.
    An item of fewer words than ``width`` is one window, one without words none. Items
    that repeat count once by id; the words of an item with a null id are hit but it is
    not listed. A null text has no words. Rows that repeat are judged alike; an empty
    table gives no rows, an empty benchmark no hits.
    """
    carried = {c: "text" if c == text_column else f"carried {c}" for c in carry}  # a carried text is in a row once
    chosen = documents.select(
        F.col(f"`{id_column}`").alias("doc_id"),
        F.col(f"`{text_column}`").alias("text"),
        *(F.col(f"`{c}`").alias(name) for c, name in carried.items() if name != "text"),
    )
    items = benchmark.select(F.col(f"`{item_column}`").cast("string").alias("name"), F.col(f"`{item_text_column}`").alias("text"))
    items = items.filter(F.col("text").isNotNull()).distinct()
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    rows = chosen.select("*", none("long").alias("starts"), none("long").alias("ends"), none("string").alias("items"), none("string").alias("near"))

    def judge(batches):
        for batch in batches:
            n_hit, n_items, n_near, marks = [], [], [], []
            for starts, ends, names, near in zip(*(batch.column(c).to_pylist() for c in FOUND)):
                reached = covered = 0
                for a, b in sorted(zip(starts, ends)):
                    covered += max(0, b - max(a, reached))
                    reached = max(reached, b)
                names = sorted(set(names))
                n_hit.append(covered)
                n_items.append(len(names))
                n_near.append(len(set(near) - set(names)))
                marks.append(hashlib.sha256(",".join(names).encode()).hexdigest())
            n_words = batch.column("n_words").to_numpy()
            bad = (np.array(n_hit) > 0) & (100 * np.array(n_hit) >= percent * n_words)
            columns = [
                batch.column("doc_id"),
                batch.column("n_words"),
                pa.array(n_hit, pa.int64()),
                pa.array(n_items, pa.int64()),
                pa.array(marks, pa.string()),
                pa.array(bad, pa.bool_()),
                pa.array(n_near, pa.int64()),
                *(batch.column(carried[c]) for c in carry),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near", *carry])

    kind = rows.schema["doc_id"].dataType.simpleString()
    shown = "".join(f", `{c}` {rows.schema[carried[c]].dataType.simpleString()}" for c in carry)
    judged = f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_near long{shown}"
    for number in range(blocks):
        last = number == blocks - 1
        queries = Queries(_block(items, blocks, number), width)
        queries.rank(_frequencies(rows, queries))
        index = stage(_index(rows.drop("n_words"), queries, with_text=not last or text_column in carry), "index")
        rows = _search(index, queries, *((judge, judged) if last else ()))
    return rows
