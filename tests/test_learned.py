import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafwise.functions.encoders import hash_encoder
from leafwise.operators.indexing import document_terms
from leafwise.operators.learned import learn_encoder, term_row
from leafwise.operators.neighbours import knn_top_k
from leafwise.operators.parsing import parse_documents
from leafwise.plans.search import search_documents
from leafwise.plans.staging import stage
from leafwise.sources.tables import build_index

TOPICS, WORDS = 30, 40


def sentence(draw, topic, n=25):
    """Words of one topic, each topic's drawn from many, beside words that all share."""
    own = [f"t{topic}w{draw.randrange(WORDS)}" for _ in range(n)]
    return " ".join(own + [f"common{draw.randrange(60)}" for _ in range(n)])


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(5)
    rows = [(f"/d/{t}-{i}.txt", sentence(draw, t)) for t in range(TOPICS) for i in range(12)]
    files = spark.createDataFrame(rows, "file_path string, text string").repartition(4)
    documents = stage(parse_documents(files), "documents")
    return documents, stage(document_terms(documents), "document_terms")


@pytest.fixture(scope="module")
def encoder(corpus):
    return learn_encoder(corpus[1], rank=32, rows=4096)


def of_topic(spark, vectors, encoder):
    draw = random.Random(6)
    asked = spark.createDataFrame([(t, sentence(draw, t, 12)) for t in range(TOPICS)], "query_id long, query string")
    found = knn_top_k(vectors, asked.select("query_id", encoder(F.col("query")).alias("embedding"))).collect()
    return sum(r["doc_id"].startswith(f"{r['query_id']}-") for r in found) / len(found)


def test_finds_texts_of_one_topic_better_than_hashed_words(spark, corpus, encoder):
    documents, terms = corpus
    learned = of_topic(spark, encoder.of_terms(terms), encoder)
    plain = hash_encoder(32)
    hashed = of_topic(spark, plain.of_terms(terms), plain)
    assert learned > 0.9 and learned > hashed + 0.2


def test_directions_are_the_singular_vectors(spark, corpus):
    """Nearly all of what the best directions of the whole table hold."""
    documents, terms = corpus
    rows = 512
    counts = np.zeros((TOPICS * 12, rows))
    for i, r in enumerate(terms.collect()):
        for f in r["fields"]:
            if f["field"] != "headings":
                for t in f["terms"]:
                    counts[i, term_row(t["value"], rows)] += t["n"]
    df = (counts > 0).sum(axis=0)
    idf = np.where(df > 0, np.log((1 + len(counts)) / (1 + df)) + 1, 0)
    table = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    table /= np.linalg.norm(table, axis=1)[:, None]
    best = (np.linalg.svd(table, compute_uv=False)[:20] ** 2).sum()
    encoder = learn_encoder(terms, rank=20, rows=rows, rounds=4)
    projection = next(c.cell_contents for c in encoder.of_terms.__closure__ if getattr(c.cell_contents, "shape", None) == (rows, 20))
    assert ((table @ projection) ** 2).sum() > 0.98 * best


def test_column_and_table_give_the_same(spark, corpus, encoder):
    documents, terms = corpus
    text = F.concat_ws(" ", "title", F.coalesce("background", F.lit("")), F.coalesce("scope", F.lit("")), "content")
    one = {r["id"]: r["v"] for r in documents.select("id", encoder(text).alias("v")).collect()}
    two = {r["id"]: r["embedding"] for r in encoder.of_terms(terms).collect()}
    assert set(one) == set(two) and all(np.allclose(one[i], two[i], atol=1e-5) for i in one)


def test_search_with_it(spark, corpus, encoder):
    documents, _ = corpus
    index = build_index(documents, encoder)
    asked = spark.createDataFrame([(0, "t3w1 t3w2 t3w3 t3w4")], "query_id long, query string")
    assert search_documents(asked, index, encoder).filter("rank <= 5 AND id LIKE '3-%'").count() == 5


def test_texts_without_terms_and_empty_corpus(spark, corpus, encoder):
    rows = spark.createDataFrame([("",), (None,), ("zzz",)], "t string").select(encoder(F.col("t")).alias("v")).collect()
    assert all(len(r["v"]) == 32 for r in rows) and set(rows[0]["v"]) == set(rows[1]["v"]) == {0.0}
    nothing = learn_encoder(corpus[1].limit(0), rank=4, rows=64)
    assert set(spark.range(1).select(nothing(F.lit("a b"))).first()[0]) == {0.0}
