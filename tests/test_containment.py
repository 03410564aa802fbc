import random

import pytest
from pyspark.sql import functions as F

from leafwise.operators import containment


def tables(spark, texts, patterns):
    value = F.struct(F.concat(F.lit("f"), "i").alias("file_name"), F.concat(F.lit("/p/"), "i").alias("file_path"))
    rows = lambda strings, name: spark.createDataFrame([(s, f"{i:04}") for i, s in enumerate(strings)], f"{name} string, i string")
    return rows(texts, "text").select("text", value.alias("value")), rows(patterns, "pattern").select("pattern", value.alias("value"))


def strings(n, seed, longest=12):
    draw = random.Random(seed)
    return sorted({"".join(draw.choice("abä漢-") for _ in range(draw.randint(1, longest))) for _ in range(n)})


def brute(texts, patterns, by):
    best = {}
    for t, text in enumerate(texts):
        for p, pattern in enumerate(patterns):
            if pattern in text:
                entry, value = (pattern, f"f{t:04}") if by == "pattern" else (text, f"f{p:04}")
                best[entry] = min(best.get(entry, value), value)
    return best


@pytest.mark.parametrize("by", ["pattern", "text"])
@pytest.mark.parametrize("chars", [1 << 20, 40])
def test_against_brute_force(spark, monkeypatch, by, chars):
    """One block for all, and many blocks, split ones and parts of texts."""
    monkeypatch.setattr(containment, "PATTERN_CHARS", chars)
    monkeypatch.setattr(containment, "TEXTS", 30)
    texts, patterns = strings(200, 1, 20), strings(150, 2, 6) + ["-" * 4 + f"{i}" for i in range(30)]
    texts += ["x" + p + "y" for p in patterns[-10:]]
    t, p = tables(spark, texts, patterns)
    found = containment.least_match(t, p.select("pattern"), by) if by == "pattern" else containment.least_match(t.select("text"), p, by)
    rows = {r[by]: r["value"]["file_name"] for r in found.collect()}
    assert rows == brute(texts, patterns, by)


def test_nothing_to_find(spark):
    t, p = tables(spark, ["abc"], ["zz"])
    assert containment.least_match(t, p.select("pattern"), "pattern").collect() == []
    assert containment.least_match(t.limit(0), p.select("pattern"), "pattern").collect() == []
    assert containment.least_match(t, p.select("pattern").limit(0), "pattern").collect() == []


def test_no_row_per_substring(spark, monkeypatch):
    """With one block no text is exploded, and no list of lengths is collected."""
    t, p = tables(spark, strings(50, 3, 30), strings(50, 4, 8))
    plan = containment.least_match(t, p.select("pattern"), "pattern")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("substring") == 0
