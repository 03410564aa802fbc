"""Writing of exports."""

from pyspark.sql import DataFrame


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; quotes are doubled, line breaks stay inside quotes."""
    writer = rows.write.mode("overwrite").option("header", True).option("quote", '"')
    writer.option("escape", '"').option("emptyValue", "").option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Report blocks as JSON lines in report order."""
    blocks.orderBy("ord", "block_no").write.mode("overwrite").json(path)
