"""Text tables as document input."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """``(id, file_path, text)`` of already extracted texts."""
    name = F.concat_ws("-", "source", F.col("doc_id").cast("string"))
    path = F.concat(F.lit("/corpus/"), F.col("source"), F.lit("/"), name, F.lit(".txt"))
    return read_table(spark, folder, "documents").select(
        name.alias("id"), path.alias("file_path"), "text"
    )
