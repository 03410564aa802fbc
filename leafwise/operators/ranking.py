"""Order, pages and totals."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwise.plans.joins import join_small, top_per_group
from leafwise.schema import SCORE_DIGITS


def score_order(score="score", tie="doc_id"):
    """Best first; equal scores by id."""
    return [F.desc(F.round(score, SCORE_DIGITS)), F.asc(tie)]


def page_bounds(queries: DataFrame, *more) -> DataFrame:
    """First and last rank of each query's page; a page has at most ``limit`` rows."""
    rows = F.least("page_size", "limit")
    first = (F.col("page") - 1) * F.col("page_size")
    return queries.select(
        "query_id", "page", "page_size", *more, (first + 1).alias("first_rank"), (first + rows).alias("last_rank")
    )


def deepest_rank(bounds: DataFrame) -> int:
    return bounds.agg(F.max("last_rank")).first()[0] or 0


def rank_and_page(scores: DataFrame, queries: DataFrame, deepest=None) -> DataFrame:
    """``(query_id, rank, doc_id, score)`` of the rows on each query's page.

    Ranking stops at the deepest page of the batch, so that map tasks send on
    only as many rows per query.
    """
    bounds = page_bounds(queries)
    deepest = deepest_rank(bounds) if deepest is None else deepest
    top = top_per_group(
        scores.select("query_id", "doc_id", "score"), "query_id", score_order(), deepest, salt_by="doc_id"
    )
    on_page = F.col("rank").between(F.col("first_rank"), F.col("last_rank"))
    paged = join_small(top, bounds, "query_id").filter(on_page)
    return paged.select("query_id", F.col("rank").cast("int"), "doc_id", "score")


def count_total(scores: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits per query before paging; 0 for a query without hits."""
    counts = scores.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    return queries.select("query_id").join(counts, "query_id", "left").select(
        "query_id", F.coalesce("total", F.lit(0)).cast("bigint").alias("total")
    )
