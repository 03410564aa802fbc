"""Join strategy by measured size, and top-k per group without hot tasks."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A side is broadcast only when its rows and bytes were measured to lie below these.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 128 << 20
# Pieces a hot key is split into when neither side can be broadcast and Spark does not split skewed joins.
SALTS = 32
# Spark limits ranks inside each map task up to this k (a fixed default of Spark's).
RANK_PUSHDOWN_LIMIT = 1000


def _width(field) -> Column:
    """Bytes of a value, about as Spark keeps it in memory."""
    column, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, T.StringType):
        size = F.octet_length(column)
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        size = 8 * F.size(column)
    elif isinstance(kind, T.AtomicType):
        return F.lit(8)
    else:
        size = F.octet_length(F.to_json(F.struct(column)))
    return 16 + F.coalesce(size, F.lit(0))


def fits_broadcast(df: DataFrame, max_rows=BROADCAST_ROWS, max_bytes=BROADCAST_BYTES) -> bool:
    """Measure ``df``; every task sends on its own count and sum only."""
    width = sum((_width(f) for f in df.schema), F.lit(0))
    rows, size = df.agg(F.count(F.lit(1)), F.sum(width.cast("bigint"))).first()
    return rows <= max_rows and (size or 0) <= max_bytes


def _splits_skew(df: DataFrame) -> bool:
    """Whether Spark splits hot keys of merge joins."""
    return all(df.sparkSession.conf.get(f"spark.sql.adaptive.{c}", "true").lower() == "true" for c in ("enabled", "skewJoin.enabled"))


def join_small(
    big: DataFrame, small: DataFrame, on, salt_by=None, how="inner", max_rows=BROADCAST_ROWS
) -> DataFrame:
    """Join a big table with one that is usually small.

    A measured small side is broadcast, so ``big`` is not shuffled. Beyond the
    bound both sides are shuffled and merged, by a hint: Spark's own choice goes by the
    size of files, which are compressed, and may broadcast what was found too large.
    Spark splits the hot keys of a merge join. Where that is turned off, with ``salt_by``
    (a column of ``big`` that varies within a key) every key of ``big`` is spread over
    ``SALTS`` tasks and ``small`` is repeated for each, so a hot key cannot fill one task.
    """
    on = [on] if isinstance(on, str) else list(on)
    if fits_broadcast(small, max_rows):
        return big.join(F.broadcast(small), on, how)
    if salt_by is None or _splits_skew(big):
        return big.join(small.hint("merge"), on, how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int"))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(repeated.hint("merge"), [*on, "_salt"], how).drop("_salt")


def split_frequent(small: DataFrame, count: str, max_rows=BROADCAST_ROWS, max_bytes=BROADCAST_BYTES) -> tuple[DataFrame | None, DataFrame | None]:
    """The rows of ``small`` with the greatest ``count``, as many as a broadcast may have, and the others; null if none.

    Both are filters by a power of two, so ``small`` should be cheap to read again.
    """
    width = sum((_width(f) for f in small.schema), F.lit(0)).cast("bigint")
    value = F.greatest(F.col(count), F.lit(1))
    size = F.floor(F.log2(value)).cast("int").alias("size")
    sizes = small.groupBy(size).agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("bytes")).collect()  # a row for each power of two
    least, n, size_ = None, 0, 0
    for row in sorted(sizes, key=lambda r: -r["size"]):
        n, size_ = n + row["n"], size_ + row["bytes"]
        if n > max_rows or size_ > max_bytes:
            break
        least = 1 << row["size"]
    else:
        return small, None
    return (None, small) if least is None else (small.filter(value >= least), small.filter(value < least))


def join_frequent(big: DataFrame, small: DataFrame, on, count: str) -> DataFrame:
    """Inner join of a big table with a small one whose ``count`` says about how many rows of ``big`` a key has.

    A small side beyond the bound of a broadcast does not shuffle all of ``big``: its
    most frequent keys, as many as the bound allows, are broadcast, and only rows of
    ``big`` with other keys are shuffled and merged, few for each key. ``big`` is read
    twice then.
    """
    on = [on] if isinstance(on, str) else list(on)
    often, seldom = split_frequent(small, count)
    if often is None:
        return big.join(seldom.hint("merge"), on)
    met = big.join(F.broadcast(often), on)
    return met if seldom is None else met.unionByName(without_frequent(big, often, on).join(seldom.hint("merge"), on))


def without_frequent(big: DataFrame, often: DataFrame, on) -> DataFrame:
    """The rows of ``big`` that meet none of ``often``, which is broadcast."""
    return big.join(F.broadcast(often.select(*on).distinct()), on, "left_anti")


def top_per_group(df: DataFrame, keys, order, k: int, salt_by, rank="rank") -> DataFrame:
    """The first ``k`` rows of each group with their rank from 1.

    For ordinary ``k`` Spark cuts each map task's rows to ``k`` per group before
    the shuffle. It does not for large ``k``; then a first pass over salted
    groups does, so that a hot group never reaches one task whole.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if k > RANK_PUSHDOWN_LIMIT:
        salt = F.pmod(F.xxhash64(salt_by), F.lit(SALTS))
        first = Window.partitionBy(*keys, salt).orderBy(*order)
        df = df.withColumn(rank, F.row_number().over(first)).filter(F.col(rank) <= k).drop(rank)
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)
