"""Search for a whole batch of queries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwise.functions.text import blank_to_null
from leafwise.operators.blocks import best_rows, hit_counts, page_scores
from leafwise.operators.highlighting import highlight, query_expansions, snippet
from leafwise.operators.matching import (
    exact_words,
    expand_words,
    is_blank,
    query_terms,
    search_term,
    with_defaults,
    word_table,
)
from leafwise.operators.neighbours import knn_top_k
from leafwise.operators.ranking import deepest_rank, page_bounds, rank_and_page
from leafwise.operators.summarizing import join_documents
from leafwise.plans.joins import join_small, top_per_group
from leafwise.plans.staging import stage


def query_vectors(queries: DataFrame, encoder) -> DataFrame:
    return queries.filter(~is_blank()).select("query_id", encoder(search_term()).alias("embedding"))


def blank_pages(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """Pages of blank queries: all documents with score 1, in order of id.

    Every blank query sees the same order, so it is made once, down to the deepest
    page asked for, instead of pairing each query with each document.
    """
    bounds = page_bounds(queries.filter(is_blank())).filter("last_rank >= first_rank")
    ids = documents.select(F.lit(0).alias("group"), F.col("id").alias("doc_id"))
    ranked = top_per_group(ids, "group", [F.asc("doc_id")], deepest_rank(bounds), salt_by="doc_id")
    asked = bounds.select(
        "query_id", F.explode(F.sequence(F.col("first_rank"), F.col("last_rank"))).alias("rank")
    )
    return join_small(asked, ranked, "rank").select(
        "query_id", F.col("rank").cast("int"), "doc_id", F.lit(1.0).alias("score")
    )


def expand(terms: DataFrame, index, fuzzy=True) -> DataFrame:
    """The index terms that the query terms of a batch stand for."""
    words = word_table(terms)
    return expand_words(words, index.term_stats, signatures=index.signatures) if fuzzy else exact_words(words, index.term_stats)


def search_pages(queries: DataFrame, index, encoder, terms: DataFrame, expanded: DataFrame, knn=True, skip=True):
    """``(pages, totals)``: ranked rows on each query's page, and hits per query.

    Both come from one pass over the blocks of the batch's words, which gives out the
    rows of pages and counts only; see ``operators.blocks``.
    """
    blanks = is_blank()
    spoken = queries.filter(~blanks)
    bounds = page_bounds(spoken)
    # no row of a page without rows is wanted
    depths = bounds.select("query_id", F.when(F.col("last_rank") >= F.col("first_rank"), F.col("last_rank")).otherwise(0).alias("depth"))
    near = knn_top_k(index.vectors, query_vectors(queries, encoder)) if knn else None
    best = best_rows(terms, expanded, depths, index.blocks, index.places, index.field_stats, near, index.dead, index.buckets, skip)
    n_blank, deepest = page_bounds(queries.withColumn("blank", blanks), "blank").agg(
        F.count_if("blank"), F.max(F.when(~F.col("blank"), F.col("last_rank")))
    ).first()
    pages = rank_and_page(page_scores(best, index.places), spoken, deepest or 0)
    totals = hit_counts(best, spoken)
    if n_blank:
        every = F.lit(index.documents.count()).cast("bigint")
        pages = pages.unionByName(blank_pages(queries, index.documents))
        totals = totals.unionByName(queries.filter(blanks).select("query_id", every.alias("total")))
    return pages, totals


def search_documents(queries: DataFrame, index, encoder, fuzzy=True, knn=True) -> DataFrame:
    """Results of every query: keyword and vector hits fused, ranked, paged and highlighted.

    Documents are joined only for the rows on a page.
    """
    queries = with_defaults(queries)
    terms = query_terms(queries)
    expanded = expand(terms, index, fuzzy)
    pages, totals = search_pages(queries, index, encoder, terms, expanded, knn)
    pages = stage(pages, "pages")
    rows = join_documents(index.documents, pages.withColumnRenamed("doc_id", "id"), index.buckets)
    asked = queries.select("query_id", "search_fields", "page", "page_size")
    rows = highlight(join_small(rows, asked, "query_id"), query_expansions(terms, expanded))
    return rows.join(totals, "query_id").select(
        "query_id",
        "rank",
        "id",
        "title",
        snippet().alias("snippet"),
        "file_path",
        F.coalesce(blank_to_null(F.col("file_type")), F.lit("pdf")).alias("file_type"),
        F.concat(F.lit("/documents/"), F.col("id"), F.lit("/download")).alias("download_url"),
        "score",
        "highlights",
        "total",
        "page",
        "page_size",
    )
