"""Keeping a table current."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key, order) -> DataFrame:
    """The first row of each key in the given order.

    Each map task passes on one row per key, so a key with many versions does not
    reach one task whole.
    """
    keys = [key] if isinstance(key, str) else list(key)
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")


def upsert_documents(current: DataFrame, incoming: DataFrame, key="id", order=()) -> DataFrame:
    """``current`` with whole rows replaced or added by key.

    Incoming rows win over current ones; among several with one key the last by
    ``order`` wins. Applying the same rows again changes nothing.
    """
    both = current.withColumn("_batch", F.lit(0)).unionByName(incoming.withColumn("_batch", F.lit(1)))
    by = [F.desc("_batch"), *[F.desc(c) for c in ([order] if isinstance(order, str) else order)]]
    return latest(both, key, by).drop("_batch")


def delete_where(rows: DataFrame, predicate=None) -> DataFrame:
    """Rows that do not match; without a predicate none is left."""
    if predicate is None:
        return rows.limit(0)
    return rows.filter(~F.coalesce(predicate, F.lit(False)))
