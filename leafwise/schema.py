"""Declared table schemas and the fixed values that results depend on."""

from pyspark.sql import types as T

# Fixed values.
FIELDS = ("title", "headings", "background", "scope", "content")
EMBEDDED_FIELDS = ("title", "background", "scope", "content")
BACKGROUND_KEYWORDS = ("background", "introduction", "overview")
SCOPE_KEYWORDS = ("scope", "scope of work", "objectives")
SECTION_LOOKAHEAD = 100
SNIPPET_CHARS = 200
BM25_K1 = 1.2
BM25_B = 0.75
KNN_K = 10
KNN_CANDIDATES = 100
KNN_BOOST = 0.9
SUMMARY_DOCUMENTS = 3
SUMMARY_SEARCH_LIMIT = 5
SUMMARY_BULLETS = 5
MIN_SENTENCE_CHARS = 20
MARK_OPEN, MARK_CLOSE = "<mark>", "</mark>"
NO_DOCUMENTS = "No documents found to summarize."
NO_SENTENCES = "Content is too short to summarize."
SUMMARY_HEADER = "Based on the search results, here are the most relevant points:\n\n"
SUMMARY_PLACEHOLDER = "[Summary placeholder for future AI integration]"
CSV_COLUMNS = ("Title", "File Path", "Background", "Scope", "Headings")

# Scores that agree to this many decimals count as equal and are ordered by id,
# so that the summation order of a distributed aggregate cannot reorder results.
SCORE_DIGITS = 6

DOCUMENTS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("file_type", T.StringType()),
        T.StructField("headings", T.ArrayType(T.StringType())),
        T.StructField("background", T.StringType()),
        T.StructField("scope", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("category", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)
