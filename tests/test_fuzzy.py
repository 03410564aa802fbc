import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from leafwise.functions import fuzzy
from leafwise.operators import matching


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def swapped(word, *places):
    letters = list(word)
    for i in places:
        letters[i], letters[i + 1] = letters[i + 1], letters[i]
    return "".join(letters)


def wanted_distance(term, other):
    limit = 0 if len(term) < 3 else 1 if len(term) < 6 else 2
    if levenshtein(term, other) > 2 * limit:  # a swap is two plain edits
        return None
    variants = [(0, term)]
    places = range(len(term) - 1)
    if limit >= 1:
        variants += [(1, swapped(term, i)) for i in places]
    if limit >= 2:
        variants += [(2, swapped(term, i, j)) for i, j in combinations(places, 2) if j - i > 1]
    best = min(cost + levenshtein(v, other) for cost, v in variants)
    return best if best <= limit else None


def mutated(rng, word, edits):
    for _ in range(edits):
        kind, i = rng.randrange(4), rng.randrange(len(word) or 1)
        if kind == 0:
            word = word[:i] + rng.choice("abcñ") + word[i:]
        elif kind == 1:
            word = word[:i] + word[i + 1 :]
        elif kind == 2:
            word = word[:i] + rng.choice("abcñ") + word[i + 1 :]
        elif i + 1 < len(word):
            word = swapped(word, i)
    return word


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(5)
    sizes = [1, 2, 3, 4, 5, 6, 7, 9, 22, 23, 24, 25, 26, 27, 31]
    words = ["".join(rng.choice("abcñd") for _ in range(rng.choice(sizes))) for _ in range(400)]
    return [(w, mutated(rng, w, rng.randrange(4))) for w in words]


def test_distance_equals_definition(spark, pairs):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    found = rows.orderBy("i").select(fuzzy.swap_distance(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in found] == [wanted_distance(a, b) for a, b in pairs]


def test_expansion_equals_brute_force(spark, pairs):
    few = [(a, b) for a, b in pairs if a and b][:130]
    words = sorted({a for a, _ in few})
    vocabulary = sorted({b for _, b in few} | set(words))
    terms = spark.createDataFrame([(1, "content", w, 1) for w in words], "query_id long, field string, term string, mult long")
    stats = spark.createDataFrame([("content", v, 1) for v in vocabulary], "field string, term string, df long")
    rows = matching.fuzzy_expand(terms, stats, limit=10**6).collect()
    found = {(r["term"], r["expansion"], round(r["weight"], 9)) for r in rows}
    wanted = set()
    for w in words:
        for v in vocabulary:
            if abs(len(w) - len(v)) <= 2:
                d = wanted_distance(w, v)
                if d is not None and d < min(len(w), len(v)):
                    wanted.add((w, v, round(1 - d / min(len(w), len(v)), 9)))
    assert found == wanted


def test_best_fifty(spark):
    vocabulary = ["aaaa"] + [f"aaa{chr(98 + i % 24)}" for i in range(24)] + [f"{chr(98 + i)}aaa" for i in range(24)]
    vocabulary += [f"a{chr(98 + i)}aa" for i in range(24)]
    stats = spark.createDataFrame([("title", v, 2) for v in vocabulary], "field string, term string, df long")
    terms = spark.createDataFrame([(1, "title", "aaaa", 1)], "query_id long, field string, term string, mult long")
    every = ["aaaa"] + sorted(set(vocabulary) - {"aaaa"})

    def found(**limit):
        rows = matching.fuzzy_expand(terms, stats, **limit).orderBy(F.desc("weight"), "expansion").collect()
        return [r["expansion"] for r in rows]

    assert found(limit=50) == every[:50]
    assert found() == every


def test_edit_limits(column):
    assert column(fuzzy.max_edits, ["ab", "abc", "abcde", "abcdef"]) == [0, 1, 1, 2]
