"""Blocked Bloom filters as tables.

A filter is a table of blocks of eight 64-bit words; a key sets one bit in each of two
words of its block, so that a look-up reads one row. The number of blocks has a bound,
so the table is broadcast whatever the number of keys; with more keys than it can hold
it passes more false hits, which an exact join afterwards removes.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most blocks of a filter, of 64 bytes each (4 MiB).
MAX_BLOCKS = 1 << 16
#: Keys to a block.
KEYS_PER_BLOCK = 16


def blocks_for(keys: int, max_blocks: int = MAX_BLOCKS) -> int:
    return min(max_blocks, 1 << max(3, (keys // KEYS_PER_BLOCK).bit_length()))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(key, F.lit(blocks)).cast("int")


def _bits(key: Column) -> list[tuple[Column, Column]]:
    """For each of the two probes the word in the block and the bit in the word."""
    other = F.xxhash64(key)
    at = lambda shift, n: F.shiftrightunsigned(other, shift).bitwiseAND(F.lit(n - 1)).cast("int")
    return [(at(0, 4), at(8, 64)), (at(16, 4) + 4, at(24, 64))]


def bloom_of(keys: DataFrame, key: Column, blocks: int) -> DataFrame:
    """``block, words`` (eight numbers) for the keys of a table; empty blocks are left out."""
    bits = F.array(*(F.struct(w.alias("word"), b.alias("bit")) for w, b in _bits(key)))
    set_bits = keys.select(_block(key, blocks).alias("block"), F.explode(bits).alias("x")).select("block", "x.*")
    # a bit of each word of the block, 0 where the row is about another word
    words = [F.bit_or(F.when(F.col("word") == w, F.expr("shiftleft(1L, bit)")).otherwise(F.lit(0).cast("long"))) for w in range(8)]
    return set_bits.groupBy("block").agg(F.array(*words).alias("words"))


def marked(rows: DataFrame, key: Column, bloom: DataFrame, blocks: int, name: str = "maybe") -> DataFrame:
    """``rows`` with a flag: false when the key is surely not in the filter."""
    passes = F.lit(True)
    for word, bit in _bits(key):
        value = F.element_at("bloom_words", word + 1)
        passes = passes & (F.call_function("shiftrightunsigned", value, bit).bitwiseAND(F.lit(1)) == 1)
    # no more than `blocks` rows of 64 bytes
    side = F.broadcast(bloom.select(F.col("block").alias("bloom_block"), F.col("words").alias("bloom_words")))
    joined = rows.join(side, _block(key, blocks) == F.col("bloom_block"), "left")
    return joined.withColumn(name, F.coalesce(passes, F.lit(False))).drop("bloom_block", "bloom_words")
