import hashlib
import re

import pytest

from leafwise.llm import decontamination
from leafwise.llm.decontamination import contamination
from leafwise.plans.staging import stage
from tests.llm.cases import SMALL, documents, empty, frame, rows

COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return SPLIT.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items):
    windows = {}
    for name, text in items:
        own = words_of(text)
        for i in range(max(len(own) - 12, min(len(own), 1))):
            windows.setdefault(tuple(own[i : i + 13]), set()).add(name)
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text, *_ in docs:
        own, hit, found = words_of(text), set(), set()
        for n in sizes:
            for i in range(len(own) - n + 1):
                if (names := windows.get(tuple(own[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= {str(x) for x in names if x is not None}
        mark = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(own), len(hit), len(found), mark, bool(hit) and 20 * len(hit) >= len(own)))
    return sorted(out, key=repr)


def items(spark):
    given = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    return given + [(901, "Two, THREE! four"), (902, None), (903, " -- "), (904, "one"), (905, "one"), (None, "12345"), (904, "one"), (10, "n1 n2 n3 n4 n5 n6 n7 n8 n9 n10 n11 n12 n13 n14")]


@pytest.mark.parametrize("block_bytes", [3000, 1 << 20])
def test_against_brute_force(spark, block_bytes):
    made = items(spark)
    benchmark = spark.createDataFrame([(a, b, "x", 1) for a, b in made], "item_id long, text string, `row` string, name int")
    found = contamination(frame(spark, documents()), benchmark, block_bytes=block_bytes)
    assert rows(found, *COLUMNS) == brute(documents(), made)


def test_proximity(spark):
    phrase = "alpha beta gamma delta"
    docs = [(1, "x alpha y beta gamma z delta", "en", "s"), (2, f"so {phrase} it is", "en", "s"), (3, "alpha beta " + "filler " * 60 + "gamma delta", "en", "s")]
    benchmark = spark.createDataFrame([(1, phrase), (2, "alpha beta"), (3, "beta gamma")], "item_id long, text string")
    found = {r["doc_id"]: (r["n_items"], r["n_near"]) for r in contamination(frame(spark, docs), benchmark).collect()}
    assert found == {1: (1, 1), 2: (3, 0), 3: (1, 0)}


def test_proximity_without_a_phrase(spark):
    docs = [(1, "x alpha y beta gamma z delta", "en", "s"), (2, "alpha beta " + "filler " * 60 + "gamma delta", "en", "s"), (3, "delta gamma", "en", "s"), (4, "beta alpha", "en", "s")]
    benchmark = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    found = {r["doc_id"]: (r["n_items"], r["n_near"]) for r in contamination(frame(spark, docs), benchmark).collect()}
    assert found == {1: (0, 1), 2: (0, 0), 3: (0, 0), 4: (0, 0)}


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in contamination(frame(spark, documents()), none).collect()} == {0}
    assert contamination(empty(spark), spark.createDataFrame(items(spark), "item_id long, text string")).collect() == []


def test_a_carried_text_is_in_a_row_once(spark, monkeypatch):
    staged = []
    monkeypatch.setattr(decontamination, "stage", lambda df, name: staged.append(df.columns) or stage(df, name))
    benchmark = spark.createDataFrame(items(spark), "item_id long, text string")
    found = contamination(frame(spark, documents()), benchmark, carry=("text", "lang"), block_bytes=3000)
    assert {tuple(c for c in columns if "text" in c) for columns in staged} == {("text",)}
    assert rows(found, *COLUMNS) == brute(documents(), items(spark))
    assert rows(found, "doc_id", "text", "lang") == rows(frame(spark, documents()), "doc_id", "text", "lang")
    contamination(frame(spark, documents()), benchmark, carry=("lang",))
    assert "text" not in staged[-1]
