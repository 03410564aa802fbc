import zlib

import numpy as np
from pyspark.sql import functions as F

from leafwise.llm.language import LETTERS, Encoder, identify_languages, letter_vectors
from leafwise.llm.queries import op9_language_id
from tests.llm.cases import documents, empty, frame


def test_held_out_accuracy(spark):
    given = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    found = [r for r in op9_language_id(spark, "/root/testdata/sf0.01").collect()]
    assert len(found) == len(given)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    held = [r for r in found if r["held_out"]]
    right = np.mean([r["lang_pred"] == given[r["doc_id"]] for r in held])
    assert right > 0.95
    assert all(0 <= r["score"] <= 1 for r in found)


def test_awkward_documents(spark):
    found = {r["doc_id"]: r for r in identify_languages(frame(spark, documents()), F.col("doc_id") != 100_012).collect()}
    assert [found[i]["lang_pred"] for i in (100_001, 100_002, 100_003, 100_013)] == ["und"] * 4
    assert found[100_001]["score"] == 0
    assert found[100_012]["held_out"] and not found[100_004]["held_out"]
    assert found[100_007]["lang_pred"] == found[100_008]["lang_pred"]


def test_grams_of_pieces_equal_those_of_the_whole(monkeypatch):
    from leafwise.llm import language

    text = "Some words, of Äll kinds;  and 12 more! " * 9
    whole = Encoder(64).grams(text)
    for size in (7, 16, 61):
        monkeypatch.setattr(language, "PIECE", size)
        pieces = Encoder(64).grams(text)
        assert (pieces[0] == whole[0]).all() and (pieces[1] == whole[1]).all()


def test_nothing_learned(spark):
    found = identify_languages(frame(spark, documents()[:3]), F.lit(False)).collect()
    assert {r["lang_pred"] for r in found} == {"und"}
    assert identify_languages(empty(spark)).collect() == []


def plain_vector(text, table):
    """A text's vector by the definition, letter by letter."""
    shown = [1 + ord(c) % (LETTERS - 1) if c.isalpha() else 0 for c in f" {(text or '').lower()} "]
    places = [p for i, p in enumerate(shown) if p or i == 0 or shown[i - 1]]
    total = np.zeros(table.shape[1])
    for a, b, c in zip(places, places[1:], places[2:]):
        if b:
            total += np.roll(table[a], 2) * np.roll(table[b], 1) * table[c]
    return total / np.linalg.norm(total) if total.any() else None


def test_against_brute_force(spark):
    """Profiles and cosines made plainly give the same languages and scores."""
    cases = [d for d in documents() if len(d[1] or "") < 3000][:90] + [(200_000, "Ünïcödé  ÀÉ, ß 12 x", None, "s"), (200_001, "y", None, "s")]
    table = letter_vectors(256).astype(int)
    vectors = {d: plain_vector(d[1], table) for d in cases}
    learned = {}
    for d, v in vectors.items():
        if v is not None and d[2] is not None and d[0] % 3:
            learned[d[2]] = learned.get(d[2], 0) + v
    wanted = {}
    for d, v in vectors.items():
        scores = {} if v is None else {name: float(v @ p / np.linalg.norm(p)) for name, p in learned.items()}
        best = min(scores, key=lambda name: (-scores[name], name), default="und")
        wanted[d[0]] = (best, max(scores.get(best, 0.0), 0.0))
    found = identify_languages(frame(spark, cases), F.col("doc_id") % 3 != 0, dimensions=256).collect()
    assert len(found) == len(cases)
    for r in found:
        name, cosine = wanted[r["doc_id"]]
        assert abs(r["score"] - cosine) < 1e-4 and (r["lang_pred"] == name or cosine < 1e-4), r
