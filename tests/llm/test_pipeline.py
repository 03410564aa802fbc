import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from tests.llm.cases import documents, frame
from tests.llm.test_decontamination import brute as contaminated
from tests.llm.test_near_duplicates import brute as components
from tests.llm.test_secrets import EXTRA

SF = "/root/testdata/sf0.001"


def test_stages_one_after_another(spark):
    cases = documents() + EXTRA[:4]
    docs = frame(spark, cases).withColumn("n_chars", F.length("text").cast("long"))
    stages = dict(corpus_pipeline.STAGES)
    rest = {d[0]: d for d in cases}

    docs = corpus_pipeline.stage(stages["language_id"](spark, docs, SF), "t")
    assert sorted(docs.columns) == sorted(corpus_pipeline.COLUMNS)
    ids = [r[0] for r in docs.select("doc_id").collect()]
    assert set(rest) - set(ids) == {100_001, 100_002, 100_003, 100_013}
    rest = {i: rest[i] for i in ids}

    docs = corpus_pipeline.stage(stages["minhash_near_dedup"](spark, docs, SF), "t")
    ids = sorted(r[0] for r in docs.select("doc_id").collect())
    assert ids == sorted({r[0] for r in components(list(rest.values())) if r[3]})
    rest = {i: rest[i] for i in ids}

    docs = corpus_pipeline.stage(stages["benchmark_decontamination"](spark, docs, SF), "t")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    ids = sorted(r[0] for r in docs.select("doc_id").collect())
    assert ids == sorted(r[0] for r in contaminated(list(rest.values()), items) if not r[5])

    docs = corpus_pipeline.stage(stages["secret_scans"](spark, docs, SF), "t")
    text = {r["doc_id"]: (r["text"], r["n_chars"]) for r in docs.collect()}
    assert sorted(text) == ids
    assert text[300_001] == ("é [SECRET]' x [SECRET] [SECRET] end", 35)
    assert "AKIA" + "C" * 16 not in text[300_003][0]

    packed = stages["best_fit_packing"](spark, docs, SF)
    assert sorted({r["doc_id"] for r in packed.collect()}) == ids


@pytest.mark.parametrize("sf", [SF])
def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 100


def test_language_stage_rejects_by_cosine(spark):
    """Gibberish and code go, labelled or not; clean texts, short ones and a table without labels stay."""
    rng = random.Random(5)
    noise = lambda: " ".join("".join(rng.choices("bcdfghjklmnpqrstvwxyz", k=7)) for _ in range(200))
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    clean = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in given.collect()]
    junk = [(900_000 + i, noise(), (None, "en")[i % 2], "s") for i in range(6)]
    junk += [(900_010, "qx[i]=zk(jj,vv)^wq;kk++;" * 90, None, "s")]
    short = [(900_020, "Avec.", "fr", "s"), (900_021, "Von.", None, "s")]
    none = [(900_030, "12 + 3", "en", "s"), (900_031, None, "en", "s")]
    everything = clean + junk + short + none
    kept = {r[0] for r in corpus_pipeline.language_id(spark, frame(spark, everything), SF).select("doc_id").collect()}
    assert {d[0] for d in everything} - kept == {d[0] for d in junk + none}
    bare = [(i, text, None, s) for i, text, _, s in everything]
    kept = {r[0] for r in corpus_pipeline.language_id(spark, frame(spark, bare), SF).select("doc_id").collect()}
    assert {d[0] for d in bare} - kept == {d[0] for d in none}
