"""Result sets as rows to write out."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwise.functions.text import base_name, blank_to_null, truncate
from leafwise.schema import CSV_COLUMNS, SUMMARY_PLACEHOLDER


def export_csv(documents: DataFrame, chars: int | None = None, max_headings: int | None = None) -> DataFrame:
    """The five columns of the CSV export, in the order of ``ord`` if there is one.

    ``chars`` cuts the sections, ``max_headings`` the list of headings.
    """

    def cut(column):
        return F.coalesce(truncate(F.col(column), chars), F.lit(""))

    headings = F.coalesce(F.col("headings"), F.array().cast("array<string>"))
    values = (
        F.coalesce("title", F.lit("")),
        F.coalesce("file_path", F.lit("")),
        cut("background"),
        cut("scope"),
        F.array_join(headings if max_headings is None else F.slice(headings, 1, max_headings), " | "),
    )
    if "ord" in documents.columns:
        documents = documents.orderBy("ord")
    return documents.select(*[v.alias(name) for v, name in zip(values, CSV_COLUMNS)])


def export_report_blocks(documents: DataFrame, include_summary: bool = False, chars: int | None = None) -> DataFrame:
    """``(ord, block_no, kind, text)``: headings, paragraphs (cut to ``chars``) and page breaks in order."""

    def block(kind, text):
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"))

    def section(name, column):
        text = blank_to_null(F.col(column))
        return [
            F.when(text.isNotNull(), block("h2", F.lit(name))),
            F.when(text.isNotNull(), block("paragraph", truncate(text, chars))),
        ]

    summary = [block("h2", F.lit("AI Summary:")), block("paragraph", F.lit(SUMMARY_PLACEHOLDER))]
    # One number is all the page breaks need; no ordered pass over the set.
    last = documents.agg(F.max("ord")).first()[0]
    blocks = F.array(
        block("h1", F.coalesce("title", F.lit("Untitled"))),
        *section("Background:", "background"),
        *section("Scope:", "scope"),
        *(summary if include_summary else []),
        F.when(F.col("ord") < F.lit(last), block("page_break", F.lit(""))),
    )
    kept = F.filter(blocks, lambda b: b.isNotNull())
    rows = documents.select("ord", F.posexplode(kept).alias("no", "b"))
    return rows.select("ord", (F.col("no") + 1).alias("block_no"), "b.kind", "b.text")


def export(documents: DataFrame, format: str = "pdf", include_summary: bool = False) -> DataFrame:
    """Report blocks for ``pdf`` and ``docx``; CSV rows for any other format."""
    if format in ("pdf", "docx"):
        return export_report_blocks(documents, include_summary)
    return export_csv(documents)


def present_results(results: DataFrame) -> DataFrame:
    """The columns a reader is shown, with the number of rows of each query."""
    # A group is one page of one query.
    shown = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    plural = F.when(F.col("n") == 1, "").otherwise("s")
    return results.join(shown, "query_id").select(
        "query_id",
        "rank",
        "title",
        "snippet",
        F.upper(F.coalesce(blank_to_null(F.col("file_type")), F.lit("PDF"))).alias("type"),
        F.coalesce(blank_to_null(base_name(F.col("file_path"))), F.lit("Document")).alias("file_name"),
        F.format_string("%.2f", "score").alias("relevance"),
        F.concat(F.lit("Found "), F.col("n"), F.lit(" document"), plural).alias("found"),
    )
