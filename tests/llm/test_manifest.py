"""The manifest against a plain Merkle tree in Python."""

import hashlib

import pytest
from pyspark.sql import functions as F

from leafwise.llm.manifest import merkle_manifest
from tests.llm.cases import documents, rows

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof", "proof_sha256", "folded_root", "verified"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in doc))


def tree(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([sha("".join(low[i : i + 3])) for i in range(0, len(low), 3)])
    return levels


def steps(levels, place):
    """For each level the digests left and right of the node on the way up."""
    found = []
    for low in levels[:-1]:
        first = place - place % 3
        found.append((low[first:place], low[place + 1 : first + 3]))
        place //= 3
    return found


def brute(docs, shown):
    by_source = {}
    for d in docs:
        by_source.setdefault(d[1], []).append(d)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    sorted_docs = {s: sorted(by_source[s], key=lambda d: (d[0] is not None, d[0] or 0, leaf(d))) for s in order}
    trees = {s: tree([leaf(d) for d in sorted_docs[s]]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    found = []
    for rank, s in enumerate(order):
        for place, d in enumerate(sorted_docs[s]):
            way = steps(trees[s], place) + steps(top, rank)
            proof = "".join("".join(left + right) for left, right in way)
            folded = leaf(shown(d))
            for left, right in way:
                folded = sha("".join([*left, folded, *right]))
            found.append((d[0], leaf(d), trees[s][-1][0], top[-1][0], proof, sha(proof), folded, folded == top[-1][0]))
    return sorted(found, key=repr)


def without_lines(doc):
    even = doc[0] is not None and doc[0] % 2 == 0
    return (*doc[:4], doc[4].replace("\n", "")) if even and doc[4] is not None else doc


def table(spark, docs):
    wide = [(*d, "x", 1, 2, "t", "d") for d in docs]
    schema = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos long, size long, `of` string, digest string"
    return spark.createDataFrame(wide, schema).repartition(5)


def found(spark, docs, **more):
    even = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return rows(merkle_manifest(table(spark, docs), shown={"text": even}, proofs=True, **more), *COLUMNS)


def awkward():
    docs = [(i, s, lang, None if t is None else len(t), t) for i, t, lang, s in documents()]
    docs += [(None, "src1", None, None, "a\nb"), (None, None, None, 3, "a\nb"), (-5, "Ä", "de", 0, "x\ny"), (7, "", "de", -2, "x\ny")]
    docs += [(9, "-", "de", 1, "\n"), (9, "3:src", "de", 1, "\n")]
    docs += [(500_000, "src2", "en", 1, "same\nrow")] * 30  # rows that repeat
    return docs + [(500_001, "src2", "en", k, "one id") for k in range(5)]


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_against_plain_trees(spark, levels):
    """Blocks of 3, 9 and 2187 leaves: what a block cannot derive comes from the stored nodes."""
    docs = awkward()
    assert found(spark, docs, levels=levels) == brute(docs, without_lines)


def test_many_sources(spark):
    docs = [(i, f"s{i % 61}" if i % 7 else "hot", "en", i, f"{i}\n") for i in range(700)]
    assert found(spark, docs, levels=2) == brute(docs, without_lines)


def test_one_row_and_none(spark):
    docs = awkward()[:1]
    assert found(spark, docs) == brute(docs, without_lines)
    assert merkle_manifest(table(spark, docs).limit(0)).collect() == []


def test_hot_source_is_spread(spark):
    """Rows of one source, and rows that are alike, are numbered by several tasks."""
    docs = [(1, "hot", "en", 1, "same")] * 400 + [(i, "hot", "en", 1, "t") for i in range(400)]
    assert found(spark, docs, levels=1) == brute(docs, without_lines)
