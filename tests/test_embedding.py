from leafwise.functions.encoders import hash_encoder
from leafwise.operators import indexing as ix


def test_vectors_come_from_counts(spark):
    schema = "id string, title string, headings array<string>, background string, scope string, content string"
    rows = [("p", "low tide", ["NOT SEEN"], None, "tide", "tide by tide"), ("q", None, None, None, None, "")]
    documents = spark.createDataFrame(rows, schema)
    encoder = hash_encoder()
    asked = []
    of_terms = encoder.of_terms
    encoder.of_terms = lambda terms: asked.append(terms) or of_terms(terms)
    found = {r["id"]: r["embedding"] for r in ix.embed_documents(documents, encoder).collect()}
    whole = {r["id"]: r["v"] for r in documents.select("id", encoder(ix.embedding_text()).alias("v")).collect()}
    assert len(asked) == 1 and found == whole
