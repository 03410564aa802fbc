import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafwise.llm.scoring import Lattice, score_documents
from tests.llm.cases import documents, empty, frame


def test_base_counts_against_python(spark):
    cases = documents()
    training = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    found = {}
    for r in score_documents(frame(spark, cases), training, chunk_bytes=20_000).collect():
        found[r["doc_id"]] = r
    split = {d[0]: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), d[1] or "")) for d in cases}
    counts = Counter()
    for d in cases:
        if zlib.crc32(str(d[0]).encode()) % 7 != 2:
            counts.update([*split[d[0]], None])
    total, types = sum(counts.values()), len(counts)
    for doc_id, words in split.items():
        r, tokens = found[doc_id], [*words, None]
        assert r["held_out"] == (zlib.crc32(str(doc_id).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(t in counts for t in tokens), total)
        wanted = sum(math.log10((counts[t] + 1) / (total + types + 1)) for t in tokens)
        assert r["base_score"] == pytest.approx(wanted, rel=1e-9)
        assert -math.inf < r["score"] < 0


def test_score_is_the_sum_over_all_segmentations():
    lattice = Lattice()
    pieces = dict(zip(lattice.keys.tolist(), lattice.weights))

    def probability(text):
        if not text:
            return 1.0
        return sum(
            math.exp(pieces[key]) * probability(text[n:]) for n in range(1, len(text) + 1) if (key := lattice._key(text[:n])) in pieces
        )

    words = ["the", "é", "x\x00y", "ness", "a" * 9]
    found = lattice.log_probabilities([w.encode() for w in words])
    for word, log in zip(words, found):
        assert math.exp(log) == pytest.approx(probability(b" " + word.encode()))
    assert np.exp(lattice.weights).sum() == pytest.approx(1)


def test_learning_raises_the_training_likelihood(spark):
    docs = frame(spark, documents()[:120])
    total = lambda rounds: sum(r["score"] for r in score_documents(docs, rounds=rounds).collect())
    zero, one, two = total(0), total(1), total(2)
    assert zero < one < two


def test_nothing_learned_and_empty(spark):
    found = score_documents(frame(spark, documents()[-14:]), F.lit(False)).collect()
    assert {r["train_tokens"] for r in found} == {0} and all(r["held_out"] and math.isfinite(r["score"]) for r in found)
    assert score_documents(empty(spark)).collect() == []
    null = score_documents(frame(spark, [(None, None, None, None), (1, "word", "en", "s")])).collect()
    assert sorted(r["n_tokens"] for r in null) == [1, 2]
