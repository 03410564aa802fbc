"""Sharding by a permutation of global row numbers.

Rows are numbered from 0 in an order that the layout of the files does not touch.
A Feistel network over two mixed-radix halves permutes the numbers below ``a * b``,
the least such product that holds all rows; a number that falls outside the rows is
permuted again until it falls inside (cycle walking). The new number tells shard
(remainder) and slot (quotient), so that anyone can compute where a row number goes,
and the shards' sizes differ by one row at most.
"""

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwise.plans.staging import stage

SHARDS = 24
#: Buckets in which rows are numbered. A fixed part of the order, not a tuning knob.
BUCKETS = 4096
#: Prime modulus of the round function; the factors of the rounds follow.
MODULUS = 2147483629
ROUND_FACTORS = (1103515245, 1664525, 1013904223, 69069, 1220703125, 16807)
#: Rows that one task makes out of a counted group of equal rows.
COPIES = 1 << 16
#: Steps of the cycle walk; the domain exceeds the rows by less than its root.
STEPS = 64


def _long(value) -> Column:
    return F.lit(value).cast("long")


def _round(value: Column, k: Column, size: int) -> Column:
    t = (value + k["add"]) % _long(MODULUS)
    return (t * t % _long(MODULUS) * k["factor"] + value) % _long(MODULUS) % _long(size)


def feistel(number: Column, a: int, b: int, seed: int) -> Column:
    """A permutation of the numbers below ``a * b``.

    The rounds are folded over an array, so that each half is a variable of the fold
    and the expression does not grow with the rounds.
    """
    rounds = F.array(*(
        F.struct(_long(seed + 7919 * (k + 1)).alias("add"), _long(f).alias("factor"), F.lit(k % 2 == 0).alias("even"))
        for k, f in enumerate(ROUND_FACTORS)
    ))
    halves = F.struct((number % _long(a)).alias("l"), F.call_function("div", number, _long(a)).alias("r"))
    step = lambda h, k: F.struct(
        F.when(k["even"], (h["l"] + _round(h["r"], k, a)) % _long(a)).otherwise(h["l"]).alias("l"),
        F.when(k["even"], h["r"]).otherwise((h["r"] + _round(h["l"], k, b)) % _long(b)).alias("r"),
    )
    return F.aggregate(rounds, halves, step, lambda h: h["r"] * _long(a) + h["l"])


def permuted(number: Column, rows: int, seed: int = 0) -> Column:
    """The place of row ``number`` among ``rows``, by cycle walking."""
    a = max(1, isqrt(rows))
    b = max(1, -(-rows // a))
    steps = F.sequence(F.lit(1), F.lit(STEPS))
    walk = lambda x, i: F.when((x < rows) & (i > 1), x).otherwise(feistel(x, a, b, seed))
    done = lambda x: F.when(x < rows, x).otherwise(F.raise_error(F.lit("cycle walk too long")))
    return F.aggregate(steps, number, walk, done)


def numbered(rows: DataFrame, columns: list[str], buckets: int = BUCKETS) -> tuple[DataFrame, int]:
    """Add ``number``, gapless from 0, and return the count of rows.

    The order is by bucket (a hash of ``columns``), then by ``columns``. Equal rows are
    counted before the shuffle and made again after it, in pieces, so a row that is
    repeated without bound does not burden one task. Rows that differ in nothing are
    the same wherever they stand, hence the numbering does not depend on the layout.
    """
    mark = F.pmod(F.xxhash64(*columns), F.lit(buckets))
    groups = stage(rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies")).withColumn("bucket", mark), "groups")
    sizes = stage(groups.groupBy("bucket").agg(F.sum("copies").alias("n")), "bucket_sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    # one row per bucket: no more than `buckets` rows
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("bucket").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("base") + F.coalesce(F.sum("copies").over(within), F.lit(0))
    placed = groups.join(F.broadcast(bases), "bucket").select(*columns, "copies", first.alias("first"))
    pieces = F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))
    single = placed.filter("copies = 1").select(*columns, F.col("first").alias("number"))
    many = placed.filter("copies > 1").select("*", F.explode(pieces).alias("piece"))
    many = many.repartition("first", "piece")
    last = F.least(F.col("copies"), (F.col("piece") + 1) * COPIES) - 1
    copy = F.explode(F.sequence(F.col("piece") * COPIES, last)).alias("copy")
    many = many.select(*columns, "first", copy).select(*columns, (F.col("first") + F.col("copy")).alias("number"))
    return single.unionByName(many), total


def shard_rows(
    documents: DataFrame,
    shards: int = SHARDS,
    seed: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    Law ``rows``: the shards' counts differ by one at most. ``size``: UTF-8 bytes and
    8; a null text has none and the checksum of nothing. Null ids and repeated rows
    are placed like any other; an empty table gives no rows.
    """
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    rows = documents.select(
        F.col(f"`{id_column}`").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    ordered, total = numbered(rows, ["doc_id", "size", "text_crc32"])
    placed = ordered.withColumn("place", permuted(F.col("number"), total, seed))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"),
        F.floor(F.col("place") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
