import hashlib
import re

import pytest

from leafwise.llm.substrings import COVER, PERIOD, remove_repeated_passages
from tests.llm.cases import documents, empty, frame, rows

COLUMNS = ["doc_id", "n_words", "n_removed", "kept_sha256"]


def brute(docs):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in docs]
    least = {}
    for (doc_id, *_), words in zip(docs, split):
        for i in range(len(words) - 12):
            key = tuple(words[i : i + 13])
            least[key] = min(least.get(key, doc_id), doc_id)
    out = []
    for (doc_id, *_), words in zip(docs, split):
        gone = set()
        for i in range(len(words) - 12):
            if least[tuple(words[i : i + 13])] < doc_id:
                gone.update(range(i, i + 13))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_cover_gives_every_difference():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


@pytest.mark.parametrize("chunk_bytes", [2000, 1 << 22])
def test_against_brute_force(spark, chunk_bytes):
    shared = " ".join(f"s{i}" for i in range(60))
    cases = documents()
    for k in range(12):  # every shift of a passage of 13 words, and one that is too short
        words = shared.split()[k : k + 13 - (k == 11)]
        cases.append((500_000 + k, " ".join([f"z{k}_{i}" for i in range(k)] + words + ["end"] * 9), "en", "s"))
    cases += [(600_000, shared, "en", "s"), (499_999, shared + " extra", "en", "s"), (600_001, "loop " * 50, "en", "s"), (600_002, "loop " * 13, "en", "s")]
    assert rows(remove_repeated_passages(frame(spark, cases), chunk_bytes=chunk_bytes), *COLUMNS) == brute(cases)


def test_null_ids_and_text(spark):
    text = " ".join(f"s{i}" for i in range(20))
    docs = frame(spark, [(None, text, "en", "s"), (5, text + " a  b", "en", "s"), (None, None, None, None)])
    found = {(r["doc_id"], r["n_words"]): (r["n_removed"], r["kept_text"]) for r in remove_repeated_passages(docs, with_text=True).collect()}
    assert found == {(None, 20): (20, ""), (5, 22): (0, text + " a b"), (None, 0): (0, "")}


def test_empty_table(spark):
    assert remove_repeated_passages(empty(spark)).collect() == []
