"""Scores of documents for queries."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafwise.operators.matching import is_blank
from leafwise.plans.joins import fits_broadcast, join_small, split_frequent, without_frequent
from leafwise.plans.staging import stage
from leafwise.schema import BM25_B, BM25_K1, FIELDS

BLANK_QUERIES_AT_ONCE = 1000
# Scores of postings for words that a task makes.
SCORES_AT_ONCE = 4_000_000


def term_bucket(term, buckets: int):
    """Partition of a stored posting list, see ``sources.tables.write_index``."""
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def with_factor(expanded: DataFrame, field_stats: DataFrame) -> DataFrame:
    """Add ``factor`` and ``avgdl``: all of a score but the document's part.

    The idf of a query term comes from its most frequent expansion, so that a rare
    misspelling cannot outscore the word itself.
    """
    # One row per searched field.
    joined = expanded.join(F.broadcast(field_stats), "field")
    idf = F.log(1 + (F.col("n_docs") - F.col("df_max") + 0.5) / (F.col("df_max") + 0.5))
    return joined.withColumn("factor", F.col("weight") * idf).drop("weight", "df_max", "n_docs")


def posting_scores(wanted: DataFrame, postings: DataFrame, buckets=None) -> DataFrame:
    """Postings of the wanted terms with their scores, shuffled once by document.

    The words that an index term stands for are kept as a list, whose number goes with
    the posting: a posting is shuffled once, however many words it counts for, and not
    at all if no word wants it. Scores are made behind the shuffle. Its partitions go by
    the scores to be made (``df`` of ``wanted``), which are many more than the postings.
    Of more lists than can be broadcast those of the commonest terms are; a posting of a
    rarer term meets its list by a shuffle of such postings, and takes it along.
    A document's rows are few, so no key is hot; the aggregates after this find their
    rows in place.
    """
    kept = [c for c in ("term", "term_id") if c in wanted.columns]
    grouped = wanted.groupBy("field", F.col("expansion").alias("index_term"), "avgdl").agg(
        F.collect_list(F.struct(*kept, "factor")).alias("words"), F.sum("df").alias("scores"), F.max("df").alias("df")
    )
    grouped = stage(grouped.withColumn("list", F.monotonically_increasing_id()), "wanted", compression="zstd")
    parts = -(-(grouped.agg(F.sum("scores")).first()[0] or 0) // SCORES_AT_ONCE)
    on = ["field", "index_term"]
    if buckets:
        grouped = grouped.withColumn("bucket", term_bucket(F.col("index_term"), buckets))
        on = [*on, "bucket"]
    postings = postings.withColumnRenamed("term", "index_term")
    lists = grouped.select(*on, "list", "avgdl", "words", "df")
    often, seldom = (lists, None) if fits_broadcast(lists) else split_frequent(lists, "df")
    carried = ["field", "avgdl", "words"]
    hits = None
    if often is not None:
        hits = postings.join(F.broadcast(often.select(*on, "list")), on).select("list", "doc_id", "tf", "dl")
    if seldom is not None:
        others = postings if often is None else without_frequent(postings, often, on)
        others = others.join(seldom.hint("merge"), on).select("list", "doc_id", "tf", "dl", *carried)
        hits = others if hits is None else hits.unionByName(others, allowMissingColumns=True)
    hits = hits.repartition(parts, "doc_id") if parts > postings.sparkSession.sparkContext.defaultParallelism else hits.repartition("doc_id")
    if seldom is None:
        met = hits.join(F.broadcast(often.select("list", *carried)), "list")
    elif often is None:
        met = hits
    else:
        own = often.select("list", *[F.col(c).alias(f"own_{c}") for c in carried])
        met = hits.join(F.broadcast(own), "list", "left").select("doc_id", "tf", "dl", *[F.coalesce(f"own_{c}", c).alias(c) for c in carried])
    tf, factor = F.col("tf"), F.col("w.factor")
    norm = BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / F.col("avgdl"))
    score = factor * tf * (BM25_K1 + 1) / (tf + norm)
    each = met.select("field", "doc_id", "tf", "dl", "avgdl", F.explode("words").alias("w"))
    return each.select("field", *[f"w.{c}" for c in kept], "doc_id", score.alias("score"))


def bm25_score(
    expansions: DataFrame, postings: DataFrame, field_stats: DataFrame, buckets=None
) -> DataFrame:
    """``(query_id, field, doc_id, score)``: BM25 summed over each query's terms.

    A term counts with its best expansion in a document. What it gives a document
    is computed once per batch, then shared by all queries with that term.
    """
    expanded = expansions.select("field", "term", "expansion", "weight", "df").distinct()
    of_term = Window.partitionBy("field", "term")
    expanded = expanded.withColumn("df_max", F.max("df").over(of_term))
    scored = posting_scores(with_factor(expanded, field_stats), postings, buckets)
    best = scored.groupBy("field", "term", "doc_id").agg(F.max("score").alias("score"))
    asked = expansions.select("query_id", "field", "term", "mult").distinct()
    joined = join_small(best, asked, ["field", "term"], salt_by="doc_id")
    return joined.groupBy("query_id", "field", "doc_id").agg(
        F.sum(F.col("mult") * F.col("score")).alias("score")
    )


def keyword_scores(
    query_terms: DataFrame, expanded: DataFrame, postings: DataFrame, field_stats: DataFrame, buckets=None
) -> DataFrame:
    """``best_fields(bm25_score(...))`` with the fields side by side.

    ``expanded`` comes from ``expand_words``. A word found in several fields of a
    document takes one row, not one per field, in the two largest aggregates, and
    words go by their numbers, which keeps keys short.
    """
    wanted = with_factor(expanded, field_stats).drop("term")
    scored = posting_scores(wanted, postings, buckets)

    def in_field(field, value):
        return F.when(F.col("field") == field, value)

    best = scored.groupBy("term_id", "doc_id").agg(
        *[F.max(in_field(f, F.col("score"))).alias(f) for f in FIELDS]
    )
    # A query's multiplicity of a word in each field it searches; null in others.
    numbers = expanded.select("term", "term_id").distinct()
    asked = query_terms.groupBy("query_id", "term").agg(
        *[F.max(in_field(f, F.col("mult"))).alias(f"{f}_mult") for f in FIELDS]
    )
    asked = join_small(asked, numbers, "term", salt_by="query_id").drop("term")
    joined = join_small(best, asked, "term_id", salt_by="doc_id")
    sums = joined.groupBy("query_id", "doc_id").agg(
        *[F.sum(F.col(f"{f}_mult") * F.col(f)).alias(f) for f in FIELDS]
    )
    scores = sums.select("query_id", "doc_id", F.greatest(*FIELDS).alias("score"))
    # A word may occur only in fields its query does not search.
    return scores.filter("score is not null")


def best_fields(field_scores: DataFrame) -> DataFrame:
    """A document's score is that of its best field."""
    return field_scores.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))


def match_all(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """Every document with score 1 for each blank query.

    The result is this large by definition; search itself ranks the documents
    once for all blank queries instead (see ``plans.search``). Query ids travel in
    lists of about ``BLANK_QUERIES_AT_ONCE``, to which all documents are joined.
    """
    blank = queries.filter(is_blank()).select("query_id")
    groups = -(-blank.count() // BLANK_QUERIES_AT_ONCE) or 1
    group = F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("group")
    lists = blank.groupBy(group).agg(F.collect_list("query_id").alias("asked"))
    ids = documents.select(F.col("id").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    return join_small(ids, lists, "group", salt_by="doc_id").select(F.explode("asked").alias("query_id"), "doc_id", F.lit(1.0).alias("score"))


def hybrid_fuse(keyword: DataFrame, knn: DataFrame) -> DataFrame:
    """Hits of either kind with their scores added."""
    columns = ["query_id", "doc_id", "score"]
    both = keyword.select(*columns).unionByName(knn.select(*columns))
    return both.groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))
