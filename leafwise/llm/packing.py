"""Best-fit packing of tokenised documents into sequences of one length.

Linear grouping scheme: the lengths over ``small`` are sorted, cut into groups of
equal cardinality and rounded up to the longest of their group. The few sizes that
remain are packed by a linear program over configurations (what sizes share a
sequence), solved by column generation and rounded down. Actual pieces then take
the places of their rounded sizes, and all others are put best-fit into the space
that is left, longest first.

Only numbers of pieces per length decide all this. There are no more than
``capacity`` lengths, so the histogram is all the driver sees, whatever the size of
the corpus, and what it hands out is a table of runs: ranks of a length that go to
consecutive sequences. A piece finds its place by its rank among the pieces of its
length, which needs no shuffle of tokens and no group of pieces in one task.
"""

import base64
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafwise.llm.words import as_bytes, released, slices
from leafwise.plans.staging import stage

CAPACITY = 2048
#: Groups of the linear grouping.
GROUPS = 64
#: Segments whose tokens a task remembers; then it starts anew.
REMEMBERED = 400_000


class SegmentTokens:
    """Token ids of texts, remembering those of each space-led word.

    A text may be cut before a space that follows no white space: no token of the
    byte-level pattern has a space after another character. Texts with other white
    space before a space, or at the end, are encoded whole.
    """

    odd = re.compile(rb"[\x09-\x0d\x20\x1c-\x1f\xc2\xe1\xe2\xe3][\x80-\xbf]*\x20|[\x09-\x0d\x20\x1c-\x1f]\Z|<\|endoftext\|>")

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken

        ranks = {}
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            for line in lines:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        self.end = len(ranks)
        self.encoding = tiktoken.Encoding(
            name,
            pat_str=public_tokenizers.PATTERN,
            mergeable_ranks=ranks,
            special_tokens={"<|endoftext|>": self.end},
        )
        self.sizes = np.zeros(self.end + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)
        self.known: dict[bytes, bytes] = {}

    def whole(self, text: bytes) -> bytes:
        return array("I", self.encoding.encode(text.decode(), allowed_special="all")).tobytes()

    def learn(self, segments: set[bytes]) -> None:
        """Encode new segments in one go and cut the ids at their ends."""
        if len(self.known) + len(segments) > REMEMBERED:
            self.known.clear()
        new = [s for s in segments if s not in self.known]
        if not new:
            return
        ids = np.array(self.encoding.encode_ordinary((b" " + b" ".join(new)).decode()), dtype="<u4")
        reached = np.cumsum(self.sizes[ids])
        ends = np.cumsum(np.fromiter((len(s) + 1 for s in new), dtype=np.int64, count=len(new)))
        cuts = (np.searchsorted(reached, ends) + 1) * 4
        packed, begin = ids.tobytes(), 0
        for segment, cut in zip(new, cuts.tolist()):
            self.known[segment] = packed[begin:cut]
            begin = cut

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit numbers."""
        parts = [None if self.odd.search(t) else t.split(b" ") for t in texts]
        segments: set[bytes] = set()
        for p in parts:
            if p:
                segments.update(p[1:])
        if len(segments) > REMEMBERED // 2:
            return [self.whole(t) for t in texts]
        self.learn(segments)
        known = self.known.__getitem__
        return [
            self.whole(t) if p is None else self.whole(p[0]) + b"".join(map(known, p[1:]))
            for t, p in zip(texts, parts)
        ]


def tokenised_pieces(
    documents: DataFrame,
    tokenizer: str = "byte_bpe_50k",
    capacity: int = CAPACITY,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, part, nth[, ids]`` of every document.

    Ids are those of the public byte-level vocabulary ``tokenizer`` followed by 0.
    Only a document of more than ``capacity`` ids is cut; its first piece takes the
    remainder, all others are full. Null text is empty: one piece with the closing
    0. ``part`` and ``nth`` number the pieces of one length within a task. Rows with
    a null id and repeated rows are packed like any other. Other columns are left out.
    """
    kind = documents.schema[id_column].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part long, nth long"
    schema += ", ids array<int>" * with_ids

    def pieces(batches):
        tokens = SegmentTokens(tokenizer)
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            texts, keys = as_bytes(batch.column(1)), batch.column(0)
            for a, b in slices(texts, 1 << 20):
                row, piece, start, length, crc, nth, ids = [], [], [], [], [], [], []
                for i, packed in enumerate(tokens.encode(texts[a:b]), a):
                    packed += bytes(4)
                    n, begin, number = len(packed) // 4, 0, 0
                    size = (n - 1) % capacity + 1
                    while begin < n:
                        own = packed[begin * 4 : (begin + size) * 4]
                        row.append(i)
                        piece.append(number)
                        start.append(begin)
                        length.append(size)
                        crc.append(zlib.crc32(own))
                        nth.append(int(seen[size]))
                        if with_ids:
                            ids.append(np.frombuffer(own, dtype="<i4"))
                        seen[size] += 1
                        begin, number, size = begin + size, number + 1, capacity
                columns = [
                    keys.take(pa.array(row, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                    pa.array([part] * len(row), pa.int64()),
                    pa.array(nth, pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", "ids"]
                yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    chosen = documents.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    return chosen.mapInArrow(released(pieces), schema)


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns of ``sizes`` with how often to use each: the linear program, rounded down.

    Column generation: the basis starts with one pattern per size; a knapsack over
    the dual values finds a better pattern until there is none.
    """
    n = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    x = demand / np.diag(basis)
    longest = int(capacity // sizes.min())
    for _ in range(60 * n):
        duals = np.linalg.solve(basis.T, np.ones(n))
        best, choice = np.zeros(capacity + 1), []
        for _ in range(longest):
            offers = np.full((n, capacity + 1), -np.inf)
            for i, size in enumerate(sizes):
                offers[i, size:] = best[: capacity + 1 - size] + duals[i]
            top = offers.argmax(axis=0)
            value = offers[top, np.arange(capacity + 1)]
            choice.append(np.where(value > best, top, -1))
            best = np.maximum(best, value)
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(n), capacity
        for layer in reversed(choice):
            if (i := layer[room]) >= 0:
                column[i] += 1
                room -= sizes[i]
        direction = np.linalg.solve(basis, column)
        allowed = direction > 1e-9
        if not allowed.any():
            break
        steps = np.where(allowed, x / np.where(allowed, direction, 1), np.inf)
        leaving = int(steps.argmin())
        x = np.maximum(x - steps[leaving] * direction, 0)
        x[leaving] = steps[leaving]
        basis[:, leaving] = column
    return [(basis[:, k].astype(int), int(x[k] + 1e-6)) for k in range(n) if int(x[k] + 1e-6) > 0]


def packing_runs(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int | None = None):
    """Where the pieces of each length go: rows ``(length, rank, n, sequence, each, offset)``.

    The pieces of ``length`` with ranks ``rank`` to ``rank + n - 1`` go to the
    sequences from ``sequence`` on, ``each`` to a sequence, from place ``offset`` on.
    The second result is the number of sequences.
    """
    small = capacity // 8 if small is None else small
    runs, next_sequence = [], 0
    taken = dict.fromkeys(counts, 0)
    if counts.get(capacity):
        runs.append((capacity, 0, counts[capacity], 0, 1, 0))
        next_sequence = taken[capacity] = counts[capacity]

    large = [(length, counts[length]) for length in sorted(counts, reverse=True) if small < length < capacity]
    each = -(-sum(n for _, n in large) // groups) if large else 0
    queues: dict[int, list[list[int]]] = {}
    room = 0
    for length, n in large:
        while n:
            if not room:
                size, room = length, each
            part = min(n, room)
            queues.setdefault(size, []).append([length, part])
            n, room = n - part, room - part
    if queues:
        sizes = np.array(sorted(queues, reverse=True))
        demand = np.array([sum(n for _, n in queues[s]) for s in sizes], dtype=float)
        spaces = []
        for pattern, times in configurations(sizes, demand, capacity):
            classes = [(next_sequence, times, 0)]
            next_sequence += times
            for i in np.flatnonzero(pattern):
                for _ in range(pattern[i]):
                    queue, filled = queues[sizes[i]], []
                    for first, n, used in classes:
                        while n and queue:
                            length, left = queue[0]
                            part = min(n, left)
                            runs.append((length, taken[length], part, first, 1, used))
                            taken[length] += part
                            filled.append((first, part, used + length))
                            first, n, queue[0][1] = first + part, n - part, left - part
                            if not queue[0][1]:
                                queue.pop(0)
                        if n:
                            filled.append((first, n, used))
                    classes = filled
            spaces += classes
    else:
        spaces = []

    free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    for first, n, used in spaces:
        free[capacity - used].append((first, n))
    for length in sorted(counts, reverse=True):
        left, space = counts[length] - taken[length], length
        while left:
            while space <= capacity and not free[space]:
                space += 1
            if space > capacity:
                new = -(-left // (capacity // length))
                free[capacity].append((next_sequence, new))
                next_sequence += new
                space = capacity
            first, n = free[space].pop()
            fits = space // length
            full = min(n, left // fits)
            if full:
                runs.append((length, taken[length], full * fits, first, fits, capacity - space))
                free[space - fits * length].append((first, full))
                taken[length] += full * fits
                left, first, n = left - full * fits, first + full, n - full
            if left and n:  # fewer than fill a sequence
                runs.append((length, taken[length], left, first, left, capacity - space))
                free[space - left * length].append((first, 1))
                taken[length] += left
                left, first, n = 0, first + 1, n - 1
            if n:
                free[space].append((first, n))
    return runs, next_sequence


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to staged ``tokenised_pieces``."""
    tally = stage(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "tally")
    counts = {r[0]: r[1] for r in tally.groupBy("length").agg(F.sum("n")).collect()}
    runs, _ = packing_runs(counts, capacity, groups)
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 6)
    shift = 1 << 48
    keys = table[:, 0] * shift + table[:, 1]
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = tally.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    kept = [c for c in pieces.columns if c not in ("part", "nth")]
    chosen = ranked.select(*kept, "rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.drop("rank").schema)

    def placed(batches):
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            run = table[np.searchsorted(keys, length * shift + rank, side="right") - 1]
            nth = rank - run[:, 1]
            columns = [batch.column(c) for c in kept]
            columns.append(pa.array(run[:, 3] + nth // run[:, 4], pa.int64()))
            columns.append(pa.array(run[:, 5] + nth % run[:, 4] * length, pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, [*kept, "sequence_id", "offset"])

    return chosen.mapInArrow(placed, f"{schema}, sequence_id long, offset long")


def pack_documents(documents: DataFrame, tokenizer: str = "byte_bpe_50k", capacity: int = CAPACITY, groups: int = GROUPS, with_ids: bool = False, **columns) -> DataFrame:
    """Tokenise ``documents`` and place every piece in a sequence of ``capacity`` tokens.

    An empty table gives no rows. See ``tokenised_pieces`` for nulls and long texts.
    """
    pieces = stage(tokenised_pieces(documents, tokenizer, capacity, with_ids=with_ids, **columns), "pieces")
    return pack(pieces, capacity, groups)


def sequences(packed: DataFrame) -> DataFrame:
    """Whole sequences of pieces with ``ids``: ``sequence_id, ids``. Bounded by the capacity."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
