import os
import re
from urllib.parse import urlparse

import numpy as np
import pytest

from leafwise.llm import near_duplicates as nd
from tests.llm.cases import documents, empty, frame, rows

COLUMNS = ["doc_id", "n_shingles", "component_id", "kept"]


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def brute(docs):
    sets = []
    for doc_id, text, *_ in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    label = list(range(len(docs)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j]:
                shared = len(sets[i] & sets[j])
                if 100 * shared >= 85 * (len(sets[i]) + len(sets[j]) - shared):
                    label[root(i)] = root(j)
    low = {}
    for i, d in enumerate(docs):
        low[root(i)] = min(low.get(root(i), d[0]), d[0])
    return sorted([(d[0], len(sets[i]), low[root(i)], low[root(i)] == d[0]) for i, d in enumerate(docs)], key=repr)


def test_against_brute_force(spark):
    docs = documents()
    assert rows(nd.near_duplicates(frame(spark, docs)), *COLUMNS) == brute(docs)


def test_chains_of_links_in_small_blocks(spark, monkeypatch):
    """Members that are unlike a band's least class still find each other."""
    monkeypatch.setattr(nd, "BLOCK", 3)
    monkeypatch.setattr(nd, "MEMBERS", 2)
    base = [f"w{i}" for i in range(120)]
    docs = [(k, " ".join(f"x{k}y{i}" if i < 4 * k else w for i, w in enumerate(base)), "en", "s") for k in range(12)]
    docs += [(100 + k, d[1] + " end", "en", "s") for k, d in enumerate(docs)]
    assert rows(nd.near_duplicates(frame(spark, docs)), *COLUMNS) == brute(docs)


def test_empty_table(spark):
    assert nd.near_duplicates(empty(spark)).collect() == []


def test_null_ids(spark):
    docs = [(None, "a b c d e f", "en", "s"), (7, "a b c d e f", "en", "s"), (None, "other words of some length", "en", "s")]
    assert rows(nd.near_duplicates(frame(spark, docs)), *COLUMNS) == sorted([(None, 2, 7, False), (7, 2, 7, True), (None, 1, None, True)], key=repr)


@pytest.mark.parametrize("size", [1, 5, 90, 3000])
def test_signatures_estimate_similarity(size):
    random = np.random.default_rng(size)
    both = random.integers(0, 1 << 63, size * 2).astype(np.uint64)
    one, two = both[: size + size // 2], both[size // 2 :]
    signature = nd.superminhash(np.concatenate((one, two)), np.array([0, len(one), len(one) + len(two)]), 256)
    similarity = len(np.intersect1d(one, two)) / len(np.union1d(one, two))
    assert abs((signature[0] == signature[1]).mean() - similarity) < 0.15
    assert (nd.superminhash(both[:0], np.array([0, 0]), 8) == ~np.uint64(0)).all()


def test_pairs_of_a_band_are_compared_once_and_by_texts(spark, monkeypatch):
    docs = []
    for i in range(0, 120, 2):  # 60 pairs at a similarity of about 0.75, each of bands of its own
        words = [f"w{i}x{j}" for j in range(400)]
        docs += [(i, " ".join(words), "en", "a"), (i + 1, " ".join(words[:343] + ["other"] * 57), "en", "a")]
    counted, size = {}, {}

    def staged(df, name, stage=nd.stage):
        out = stage(df, name)
        counted[name] = out.count()
        size[name] = sum(os.path.getsize(urlparse(p).path) for p in out.inputFiles())
        return out

    monkeypatch.setattr(nd, "stage", staged)
    assert rows(nd.near_duplicates(frame(spark, docs)), *COLUMNS) == brute(docs)
    assert counted["shared_bands"] > 120 and counted["salted_pairs"] > 40
    assert counted["with_partner"] == 0
    assert sum(size.values()) < sum(len(d[1]) for d in docs)
