"""Edit distance with neighbour swaps, and signatures that make it an equi-join.

The number of edits allowed grows with a query term's length: none up to two
characters, one up to five, two from six on.

Two strings within k edits share a string that is left after deleting at most k
characters from each, since a swap too is undone by deleting the same character
on both sides. Short terms are matched on such deletion strings. A long term has
too many of them, so it is cut into five segments by position: two edits or swaps
spoil at most four, so one survives, shifted by at most two.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Term length from which one and two edits are allowed.
ONE_EDIT_FROM, TWO_EDITS_FROM = 3, 6
LONG_TERM = 24
SEGMENTS = 5


def max_edits(term: Column) -> Column:
    length = F.length(term)
    return F.when(length < ONE_EDIT_FROM, 0).when(length < TWO_EDITS_FROM, 1).otherwise(2)


def _part(text, first, last):
    """Characters ``first..last``, counted from one; empty when last < first."""
    return F.substring(text, first, last - first + 1)


def swaps(term: Column) -> Column:
    """All strings that differ from ``term`` by one swap of neighbours."""
    n = F.length(term)
    return F.when(
        n > 1,
        F.transform(
            F.sequence(F.lit(1), n - 1),
            lambda i: F.concat(
                _part(term, F.lit(1), i - 1), _part(term, i + 1, i + 1), _part(term, i, i), _part(term, i + 2, n)
            ),
        ),
    ).otherwise(F.array().cast("array<string>"))


def letter_parity(term: Column) -> Column:
    """One bit per character code (modulo 63): whether it occurs an odd number of times.

    Swaps keep it, and an edit changes at most two bits, so it tells without looking
    at the words that a swap cannot be what separates them.
    """
    letters = F.split(term, "")
    return F.aggregate(
        letters, F.lit(0).cast("bigint"), lambda acc, c: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.ascii(c) % 63))
    )


def swap_distance(term: Column, other: Column, parity=None, other_parity=None) -> Column:
    """Edits from ``term`` to ``other``, or null beyond ``max_edits(term)``.

    A variant of the term (itself, one swap, or two disjoint swaps) costs its
    swaps plus its Levenshtein distance to ``other``; the cheapest counts.
    ``parity`` and ``other_parity`` may hold the letter parities, if known.
    """
    parity = letter_parity(term) if parity is None else parity
    other_parity = letter_parity(other) if other_parity is None else other_parity
    limit = max_edits(term)
    plain = F.levenshtein(term, other, 4)  # -1 when farther, which no two edits with swaps undo
    longer = F.abs(F.length(term) - F.length(other))
    changed = F.bit_count(parity.bitwiseXOR(other_parity))
    variants = swaps(term)

    # A swap is at most two plain edits. Plain distances 2 and 4 are bettered only by
    # one and two swaps alone, and 3 by a swap and an edit.
    one_swap = F.array_contains(variants, other)
    two_swaps = F.arrays_overlap(variants, swaps(other))
    swap_and_edit = F.exists(variants, lambda v: F.levenshtein(v, other, 1) >= 0)
    only_swaps = (longer == 0) & (changed == 0)
    best = (
        F.when(plain.between(0, 1), plain)
        .when((plain == 2) & only_swaps & one_swap, 1)
        .when(plain == 2, 2)
        .when((plain == 3) & (longer <= 1) & (changed <= 2) & swap_and_edit, 2)
        .when(((plain == 3) | (plain == 4)) & only_swaps & two_swaps, 2)
    )
    return F.when(best <= limit, best)


def _with_deletions(df: DataFrame, edits) -> DataFrame:
    """One row per string left after deleting at most ``edits`` characters of ``term``.

    Two cut positions are exploded; a position beyond the end deletes nothing.
    Plain explodes stay in generated code, which nested lambdas would not.
    """
    n = F.length("term")
    end = n + 1
    first = df.withColumn("_i", F.explode(F.sequence(F.when(edits > 0, 1).otherwise(end), end)))
    last = F.greatest(F.col("_i") + 1, end)
    second = first.withColumn(
        "_j", F.explode(F.sequence(F.when(edits > 1, F.col("_i") + 1).otherwise(last), last))
    )
    i, j, term = F.col("_i"), F.col("_j"), F.col("term")
    left = F.concat(_part(term, F.lit(1), i - 1), _part(term, i + 1, j - 1), _part(term, j + 1, n))
    return second.withColumn("sig", F.xxhash64(F.lit("d"), left)).drop("_i", "_j")


def _segment_bounds(length, number):
    """First and last position of a segment of a term of the given length."""
    first = F.floor(length * number / SEGMENTS).cast("int") + 1
    last = F.floor(length * (number + 1) / SEGMENTS).cast("int")
    return first, last


def _segment_hash(length, number, segment):
    return F.xxhash64(F.lit("s"), length, number, segment)


def _numbers(first, last):
    return F.explode(F.sequence(first, last))


def vocabulary_signatures(vocabulary: DataFrame) -> DataFrame:
    """Add ``sig`` to index terms: what a query term within two edits can share."""
    n = F.length("term")
    # A query term of two edits has six characters, so its matches have four.
    edits = F.when(n >= TWO_EDITS_FROM - 2, 2).when(n >= ONE_EDIT_FROM - 1, 1).otherwise(0)
    short = _with_deletions(vocabulary.filter(n <= LONG_TERM + 2), edits)
    long = vocabulary.filter(n > LONG_TERM - 2).withColumn("_k", _numbers(F.lit(0), F.lit(SEGMENTS - 1)))
    first, last = _segment_bounds(n, F.col("_k"))
    sig = _segment_hash(n, F.col("_k"), _part(F.col("term"), first, last))
    return short.unionByName(long.withColumn("sig", sig).drop("_k"))


def query_signatures(terms: DataFrame) -> DataFrame:
    """Add ``sig`` to query terms; any index term within its edits shares one."""
    n = F.length("term")
    short = _with_deletions(terms.filter(n <= LONG_TERM), max_edits(F.col("term")))
    windows = (
        terms.filter(n > LONG_TERM)
        .withColumn("_n", _numbers(n - 2, n + 2))
        .withColumn("_k", _numbers(F.lit(0), F.lit(SEGMENTS - 1)))
        .withColumn("_s", _numbers(F.lit(-2), F.lit(2)))
    )
    first, last = _segment_bounds(F.col("_n"), F.col("_k"))
    shift = F.col("_s")
    sig = _segment_hash(F.col("_n"), F.col("_k"), _part(F.col("term"), first + shift, last + shift))
    long = windows.filter(first + shift >= 1).withColumn("sig", sig).drop("_n", "_k", "_s")
    return short.unionByName(long)
