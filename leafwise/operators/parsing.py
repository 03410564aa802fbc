"""From extracted text to documents."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwise.functions import text as t
from leafwise.schema import DOCUMENTS, EMBEDDED_FIELDS


def file_extension(path):
    """Lower-case extension with its dot; leading dots of a name do not count."""
    return F.lower(F.regexp_extract(path, r"[^./]\.*(\.[^./]*)$", 1))


def file_type_of(path):
    """``pdf``, ``docx`` or ``txt``; null when unsupported."""
    extension = file_extension(path)
    return (
        F.when(extension == ".pdf", "pdf")
        .when(extension.isin(".docx", ".doc"), "docx")
        .when(extension == ".txt", "txt")
    )


def classify_files(files: DataFrame) -> DataFrame:
    """Add ``file_type`` (null when unsupported) and ``supported``."""
    return files.withColumn("file_type", file_type_of(F.col("file_path"))).withColumn(
        "supported", F.col("file_type").isNotNull()
    )


def assemble_parts(parts: DataFrame) -> DataFrame:
    """Text of each document from its parts in order.

    Pages of a PDF are concatenated as they are; paragraphs of other types are
    joined by newlines. A group is one document, whose text is one row anyway.
    """
    ordered = F.array_sort(
        F.collect_list(F.struct("part_no", F.coalesce("text", F.lit("")).alias("text")))
    )
    grouped = parts.groupBy("file_path", "file_type").agg(ordered.alias("parts"))
    pieces = F.col("parts.text")
    joined = F.when(F.col("file_type") == "pdf", F.array_join(pieces, "")).otherwise(
        F.array_join(pieces, "\n")
    )
    return grouped.select("file_path", "file_type", joined.alias("text"))


def file_status(files: DataFrame):
    """``skipped`` without a type or text, ``failed`` on an error, else ``success``.

    An optional ``error`` column of ``files`` says what went wrong while reading a file.
    """
    supported = file_type_of(F.col("file_path")).isNotNull()
    status = F.when(~supported, "skipped")
    if "error" in files.columns:
        status = status.when(F.col("error").isNotNull(), "failed")
    return status.when(F.length(F.coalesce("text", F.lit(""))) == 0, "skipped").otherwise("success")


def parse_status(files: DataFrame) -> DataFrame:
    """``(file_path, status)``, see ``file_status``."""
    return files.select("file_path", file_status(files).alias("status"))


def ingest_report(status: DataFrame) -> DataFrame:
    """One row of counts, also for no input."""
    return status.agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("success", "failed", "skipped")]
    )


def ingest_message(report: DataFrame) -> DataFrame:
    """What a caller is told: the message and the number of indexed documents."""
    found = F.col("success") + F.col("failed") + F.col("skipped") > 0
    message = F.when(found, F.format_string("Indexed %d documents", "success")).otherwise(
        "No documents found"
    )
    return report.select(message.alias("message"), F.col("success").alias("count"))


def parse_documents(
    files: DataFrame, as_of=None, content_chars: int | None = None, section_chars: int | None = None, max_headings: int | None = None
) -> DataFrame:
    """Documents from ``(file_path, text[, id])``; one narrow projection.

    Files of unknown type and without text give no document. ``as_of`` is the
    time stamp of the batch. Whole texts are kept; the other arguments cut the content,
    sections without an end, and the list of headings.
    """
    classified = classify_files(files).filter("supported").filter(F.length("text") > 0)
    given = F.col("id") if "id" in files.columns else F.lit(None).cast("string")
    stamp = F.lit(as_of).cast("timestamp")
    with_headings = classified.withColumn("headings", t.extract_headings(F.col("text"), max_headings))
    values = {
        "id": F.coalesce(t.blank_to_null(given), t.file_stem(F.col("file_path"))),
        "title": F.coalesce(F.try_element_at("headings", F.lit(1)), t.base_name(F.col("file_path"))),
        "background": t.background(F.col("text"), section_chars),
        "scope": t.scope(F.col("text"), section_chars),
        "content": t.truncate(F.col("text"), content_chars),
        "created_at": stamp,
        "updated_at": stamp,
    }
    columns = []
    for field in DOCUMENTS:
        known = field.name in ("file_path", "file_type", "headings")
        value = F.col(field.name) if known else values.get(field.name, F.lit(None))
        columns.append(value.cast(field.dataType).alias(field.name))
    return with_headings.select(*columns).drop("embedding")


def embedding_text(content_chars: int | None = None):
    """The text that stands for a document: its fields, with content whole or cut."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in EMBEDDED_FIELDS]
    return F.concat_ws(" ", *parts[:-1], t.truncate(parts[-1], content_chars))
