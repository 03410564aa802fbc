"""Array helpers that stay inside the JVM and run in linear time."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value, body):
    """Bind ``value`` once for use several times in ``body``.

    A lambda body is evaluated per element, so an expensive expression used
    inside it must be bound outside.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def run_starts(items):
    """Zero-based positions at which a sorted array changes value."""
    return F.when(
        F.size(items) > 0,
        F.filter(
            F.sequence(F.lit(0), F.size(items) - 1),
            lambda i: (i == 0) | (items[i] != items[i - 1]),
        ),
    ).otherwise(F.array().cast("array<int>"))


def run_lengths(sorted_items: Column) -> Column:
    """Distinct values of a sorted array with their counts, in order.

    Counting inside the row needs no shuffle: a document's term frequencies
    never leave the task that tokenised it.
    """
    return let(
        sorted_items,
        lambda a: let(
            run_starts(a),
            lambda s: F.zip_with(
                s,
                F.when(F.size(s) > 0, F.concat(F.slice(s, 2, F.size(s)), F.array(F.size(a)))).otherwise(s),
                lambda b, e: F.struct(a[b].alias("value"), (e - b).alias("n")),
            ),
        ),
    )


def bucket_counts(buckets: Column, dim: int) -> Column:
    """Dense counts of ``dim`` buckets from an array of bucket numbers.

    Each bucket number is added once, so that the sorted array has exactly
    ``dim`` runs; a run's length less one is the count.
    """
    padded = F.sort_array(F.concat(buckets, F.sequence(F.lit(0), F.lit(dim - 1)).cast("array<bigint>")))
    return F.transform(run_lengths(padded), lambda r: r["n"] - 1)
