"""Language-model scores from a subword lattice.

The pieces of an existing subword vocabulary form a unigram model: a word, led by a
space, may be cut into pieces in many ways, and its probability is the sum over all of
them, found by the forward recursion in log space. A text's probability is the product
over its words and the closing token.

The vocabulary's own scores give the first weights. They are then re-estimated on the
training documents: the forward and backward recursions over each distinct training
word tell how often every piece is expected. Distinct words meet by buckets of their
hashes (see ``exchange``), so each is worked on once, however often it occurs.
"""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwise.llm import exchange
from leafwise.llm.words import U64, hash_words, sorted_groups, split_words
from leafwise.plans.staging import stage

TOKENIZER = "piece_bpe_32k"
#: Re-estimations of the weights.
ROUNDS = 2
#: Weight of the vocabulary's own scores against the expected counts, in tokens.
PRIOR = 1000.0
_BASE = U64(0x9E3779B97F4A7C15)
_LED = "▁".encode()


class Lattice:
    """The pieces by the hash of their bytes; ``weights`` are natural logarithms."""

    def __init__(self, tokenizer: str = TOKENIZER):
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{tokenizer}.model"))
        pieces: dict[bytes, float] = {}
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            piece = model.id_to_piece(i)
            own = bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.encode().replace(_LED, b" ")
            # scores of merges are negative ranks; a rank's weight falls off as Zipf's law has it
            score = math.log(1 / (2.7 + abs(model.get_score(i)))) if not model.is_byte(i) else math.log(1e-7)
            pieces[own] = max(pieces.get(own, -math.inf), score)
        for i in range(256):  # every byte has a way out
            pieces.setdefault(bytes([i]), math.log(1e-7))
        names = sorted(pieces)
        keys = np.array([self._key(p) for p in names], dtype=U64)
        order = np.argsort(keys)
        self.keys = keys[order]
        weights = np.array([pieces[names[i]] for i in order])
        self.prior = np.exp(weights) / np.exp(weights).sum()
        self.weights = np.log(self.prior)
        self.longest = max(map(len, names))

    @staticmethod
    def _key(piece: bytes) -> int:
        h = 0
        for byte in piece:
            h = (h * int(_BASE) + byte + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def arcs(self, matrix: np.ndarray):
        """``(end, width, rows, pieces)`` of all pieces in words of equal length (rows of bytes)."""
        values = matrix.astype(U64) + U64(1)
        for end in range(1, matrix.shape[1] + 1):
            key, factor = np.zeros(len(matrix), dtype=U64), 1
            for width in range(1, min(end, self.longest) + 1):
                key = key + values[:, end - width] * U64(factor)
                factor = factor * int(_BASE) & 0xFFFFFFFFFFFFFFFF
                at = np.searchsorted(self.keys, key)
                at[at == len(self.keys)] = 0
                rows = np.flatnonzero(self.keys[at] == key)
                if len(rows):
                    yield end, width, rows, at[rows]

    def forward(self, matrix: np.ndarray, arcs=None) -> np.ndarray:
        alpha = np.full((matrix.shape[1] + 1, len(matrix)), -np.inf)
        alpha[0] = 0
        for end, width, rows, pieces in arcs if arcs is not None else self.arcs(matrix):
            alpha[end, rows] = np.logaddexp(alpha[end, rows], alpha[end - width, rows] + self.weights[pieces])
        return alpha

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        out = np.empty(len(words))
        for rows, matrix in by_length(words):
            out[rows] = self.forward(matrix)[-1]
        return out

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """How often each piece is expected in ``counts`` occurrences of the words."""
        out = np.zeros(len(self.keys))
        for rows, matrix in by_length(words):
            arcs = list(self.arcs(matrix))
            alpha = self.forward(matrix, arcs)
            beta = np.full_like(alpha, -np.inf)
            beta[-1] = 0
            for end, width, own, pieces in reversed(arcs):
                beta[end - width, own] = np.logaddexp(beta[end - width, own], beta[end, own] + self.weights[pieces])
            times = counts[rows]
            for end, width, own, pieces in arcs:
                share = np.exp(alpha[end - width, own] + self.weights[pieces] + beta[end, own] - alpha[-1, own])
                out += np.bincount(pieces, share * times[own], len(out))
        return out


def by_length(words: list[bytes], block: int = 20_000):
    """``(numbers, matrix)`` of space-led words of equal length, of bounded size."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    order = np.argsort(sizes, kind="stable")
    edges = np.concatenate(([0], np.flatnonzero(np.diff(sizes[order])) + 1, [len(order)])) if len(order) else [0]
    for a, b in zip(edges[:-1], edges[1:]):
        step = max(1, min(block, block * 64 // max(1, int(sizes[order[a]]))))
        for c in range(a, b, step):
            rows = order[c : min(b, c + step)]
            led = b"".join(b" " + words[i] for i in rows)
            yield rows, np.frombuffer(led, dtype=np.uint8).reshape(len(rows), -1)


def score_documents(
    documents: DataFrame,
    training: Column | None = None,
    tokenizer: str = TOKENIZER,
    rounds: int = ROUNDS,
    id_column: str = "doc_id",
    text_column: str = "text",
    chunk_bytes: int = exchange.CHUNK_BYTES,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    ``training``: a condition on the documents (all by default; null holds out).
    Tokens are the words of the text, A-Z lower-cased, and one end. ``base_score``: log10
    by counts of whole tokens, add-one. ``score``: log10 of the text under the lattice.
    A null text is empty: it has only the end. Rows that repeat count as often; without
    training documents the vocabulary's own scores are used. An empty table gives no
    rows. Ids are integers. Other columns are left out.
    """
    training = F.lit(True) if training is None else training
    chunks = exchange.chunked(documents, id_column, text_column, training, chunk_bytes)
    bits = exchange.bucket_bits(chunks)

    def read(group):
        ids, flags, data, raw = (group.column(c)[0].as_py() for c in ("ids", "flags", "data", "raw"))
        words = split_words(exchange.texts_of(ids, data, raw), lower=True)
        keys, where, number = np.unique(hash_words(words), return_index=True, return_inverse=True)
        return ids, np.array(flags, dtype=bool), words, keys, where, number

    def send(batches):
        for _, group in sorted_groups(batches, ["chunk"]):
            _, flags, words, keys, where, number = read(group)
            counts = np.bincount(number, flags[words.text_of()], len(keys)).astype("<i8")
            plain = words.data.tobytes()
            spelled = [plain[a:b] for a, b in zip(words.starts[where].tolist(), words.ends[where].tolist())]
            runs = exchange.cuts((keys >> U64(64 - bits)).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([group.column("chunk")[0].as_py()] * len(runs), pa.int64()),
                    pa.array([r[0] for r in runs], pa.int32()),
                    pa.array([b" ".join(spelled[a:b]) for _, a, b in runs], pa.binary()),
                    pa.array([counts[a:b].astype("<u4").tobytes() for _, a, b in runs], pa.binary()),
                ],
                ["chunk", "bucket", "data", "counts"],
            )

    def gather(table):
        total = Counter()
        for data, counts in zip(table.column("data").to_pylist(), table.column("counts").to_pylist()):
            for word, n in zip(data.split(b" "), np.frombuffer(counts, dtype="<u4").tolist()):
                total[word] += n
        counts = np.fromiter(total.values(), dtype="<i8", count=len(total))
        return pa.table(
            {
                "bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()),
                "data": pa.array([b" ".join(total)], pa.binary()),
                "counts": pa.array([counts.tobytes()], pa.binary()),
                "tokens": pa.array([int(counts.sum())], pa.int64()),
                "types": pa.array([int((counts > 0).sum())], pa.int64()),
            }
        )

    def lattice_with(weights):
        lattice = Lattice(tokenizer)
        if weights is not None:
            lattice.weights = weights
        return lattice

    def expect(weights):
        def run(batches):
            lattice, total = None, None
            for batch in batches:
                lattice = lattice or lattice_with(weights)
                total = np.zeros(len(lattice.keys)) if total is None else total
                for data, counts in zip(batch.column("data").to_pylist(), batch.column("counts").to_pylist()):
                    counts = np.frombuffer(counts, dtype="<i8")
                    words = [w for w, n in zip(data.split(b" "), counts.tolist()) if n]
                    total += lattice.expected(words, counts[counts > 0].astype(float))
            if total is not None:
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["piece", "n"])

        return run

    def answer(weights):
        def run(table):
            lattice = lattice_with(weights)
            chunk = table.column("chunk").to_pylist()
            data, counts = table.column("data").to_pylist(), table.column("counts").to_pylist()
            own = chunk.index(None)
            words = data[own].split(b" ")
            known = dict(zip(words, range(len(words))))
            totals, logs = np.frombuffer(counts[own], dtype="<i8"), lattice.log_probabilities(words)
            replies = []
            for i, message in enumerate(data):
                if i != own:
                    at = np.fromiter(map(known.__getitem__, message.split(b" ")), dtype=np.int64)
                    replies.append(totals[at].astype("<i8").tobytes() + logs[at].astype("<f8").tobytes())
            buckets = [table.column("bucket")[0].as_py()] * len(replies)
            return pa.table(
                {
                    "chunk": pa.array([c for c in chunk if c is not None], pa.int64()),
                    "bucket": pa.array(buckets, pa.int32()),
                    "data": pa.array(replies, pa.binary()),
                }
            )

        return run

    messages = stage(chunks.mapInArrow(send, "chunk long, bucket int, data binary, counts binary"), "words")
    shape = "bucket int, data binary, counts binary, tokens long, types long"
    vocabulary = stage(messages.groupBy("bucket").applyInArrow(gather, shape), "vocabulary")
    ends = chunks.agg(F.sum(F.size(F.filter("flags", lambda f: f)).cast("long"))).first()[0] or 0
    sums = vocabulary.agg(F.sum("tokens"), F.sum("types")).first()
    tokens, types = (sums[0] or 0) + ends, (sums[1] or 0) + (ends > 0)

    weights, end_weight = None, math.log(1e-3)
    if tokens:
        prior = Lattice(tokenizer).prior
        for _ in range(rounds):
            pieces = vocabulary.mapInArrow(expect(weights), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n"))
            counts = prior * PRIOR
            for r in pieces.collect():  # no more rows than the vocabulary has pieces
                counts[r["piece"]] += r["n"]
            whole = counts.sum() + ends
            weights, end_weight = np.log(counts / whole), math.log(max(ends, 1e-3) / whole)

    def score(batches):
        for _, group in sorted_groups(batches, ["chunk"]):
            ids, flags, words, keys, where, number = read(group)
            sizes = [b - a for _, a, b in exchange.cuts((keys >> U64(64 - bits)).astype(np.int64))]
            answers = list(zip(group.column("data").to_pylist()[1:], sizes))
            counts = np.concatenate([np.frombuffer(d, dtype="<i8", count=n) for d, n in answers] or [np.zeros(0, dtype=np.int64)])
            logs = np.concatenate([np.frombuffer(d, dtype="<f8", offset=8 * n) for d, n in answers] or [np.zeros(0)])
            text, n = words.text_of(), len(ids)
            floor = math.log10(tokens + types + 1)
            base = np.bincount(text, np.log10(counts + 1.0)[number] - floor, n) + math.log10(ends + 1) - floor
            total = (np.bincount(text, logs[number], n) + end_weight) / math.log(10)
            known = np.bincount(text, (counts > 0)[number], n).astype(np.int64) + int(ends > 0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(~flags),
                    pa.array(words.counts.astype(np.int64) + 1),
                    pa.array(known),
                    pa.array([tokens] * n, pa.int64()),
                    pa.array(base),
                    pa.array(total),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    both = messages.unionByName(vocabulary.select(F.lit(None).cast("long").alias("chunk"), "bucket", "data", "counts"))
    replies = both.groupBy("bucket").applyInArrow(answer(weights), "chunk long, bucket int, data binary")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return exchange.with_answers(chunks, replies).mapInArrow(score, schema)
