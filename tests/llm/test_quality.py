import re

import numpy as np

from leafwise.llm.quality import covered_by, quality_rules, repeats
from leafwise.llm.words import as_bytes, hash_words, split_words
from tests.llm.cases import documents, empty, frame, rows

COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "longest_repeat"]


def brute(doc_id, text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit, longest = set(), 0
    for places in at.values():
        if len(places) > 1:
            for i in places:
                hit.update(range(i, i + 8))
            for i in places[:30]:
                for j in places[:30]:
                    if i < j:
                        n = 8
                        while j + n < len(words) and words[i + n] == words[j + n]:
                            n += 1
                        longest = max(longest, n)
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    kept = not failed and longest <= 200
    return (doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed, kept, longest)


def test_against_brute_force(spark):
    cases = documents() + [
        (200_001, "a b c d e f g h " * 9 + "x", "en", "s"),
        (200_002, "same " * 300, "en", "s"),
        (200_003, " ".join(f"q{i}" for i in range(300)) + " # " + " ".join(f"q{i}" for i in range(40, 300)), "en", "s"),
        (200_004, "line one\n\n  \nline one\nline two\n line one", "en", "s"),
    ]
    found = rows(quality_rules(frame(spark, cases)), *COLUMNS)
    wanted = sorted((brute(d[0], d[1]) for d in cases), key=repr)
    for a, b in zip(found, wanted):
        assert a == b
    assert len(found) == len(wanted)


def test_spans_of_shared_prefixes_cover_what_windows_do():
    assert covered_by(np.array([0, 3, 0, 0, 0, 2, 1, 0])).tolist() == [False, True, True, True, False, True, True, False]
    assert covered_by(np.zeros(0, dtype=np.int64)).tolist() == []
    import pyarrow as pa

    words = split_words(as_bytes(pa.array([d[1] for d in documents()] + ["same " * 300, "a b c d e f g h " * 9 + "x"])))
    length, windows = repeats(words, hash_words(words))
    assert windows.any() and (covered_by(length) == windows).all()


def test_empty_table(spark):
    assert quality_rules(empty(spark)).collect() == []
