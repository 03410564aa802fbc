"""Which texts contain which patterns: automata over blocks of patterns.

Patterns are dealt out to blocks by one of their grams, the one with the least hash, so
that a text has to meet only the blocks that a gram of its own leads to; with few
patterns there is one block, which every text meets. A block whose patterns are too
long for one automaton is split, and its texts meet each part of it. Every group of
patterns and texts builds its Aho-Corasick automaton once and reads its texts in Arrow
batches. Only the least value of each pattern or text leaves a task, not the pairs.
"""

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwise.plans.joins import join_small
from leafwise.plans.staging import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # for executors without this package

#: Characters of patterns in one automaton, and texts that meet it in one group.
PATTERN_CHARS, TEXTS = 1 << 20, 1 << 16
GRAM = 4
#: Results held by a task before they are given out.
HELD = 200_000


def _grams(text, size: int):
    """Hashes of all runs of ``size`` characters."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    none = F.array().cast("array<bigint>")
    return F.when(F.length(text) >= size, F.transform(starts, lambda i: F.xxhash64(F.substring(text, i, F.lit(size))))).otherwise(none)


def _block(key, blocks: int):
    return F.pmod(key, F.lit(blocks)).cast("int")


def least_match(texts: DataFrame, patterns: DataFrame, by: str) -> DataFrame:
    """For each pattern (``by="pattern"``) the least value of the texts that contain it; or for each text of the patterns in it.

    ``texts`` has distinct texts in ``text``, ``patterns`` distinct ones in ``pattern``,
    neither null nor empty; the table that is not ``by`` has a ``value``, a structure of
    two strings. Returns ``by`` and ``value``; what matches nothing is left out.
    """
    other = "text" if by == "pattern" else "pattern"
    kind = (texts if other == "text" else patterns).schema["value"].dataType.simpleString()
    size, shortest = patterns.agg(F.sum(F.length("pattern")), F.min(F.length("pattern"))).first()
    if not size:
        return texts.sparkSession.createDataFrame([], f"{by} string, value {kind}")
    blocks = -(-size // PATTERN_CHARS)
    if blocks == 1:
        placed, led = (df.withColumn("block", F.lit(0)) for df in (patterns, texts))
    else:
        key = F.when(F.length("pattern") < GRAM, F.xxhash64("pattern")).otherwise(F.array_min(_grams(F.col("pattern"), GRAM)))
        placed = patterns.withColumn("block", _block(key, blocks))
        sizes = [*range(shortest, GRAM), GRAM]
        led_to = F.array_distinct(F.flatten(F.array(*(F.transform(_grams(F.col("text"), s), lambda g: _block(g, blocks)) for s in sizes))))
        led = texts.withColumn("block", F.explode(led_to))
    splits = placed.groupBy("block").agg(F.ceil(F.sum(F.length("pattern")) / PATTERN_CHARS).cast("int").alias("splits"))
    parts = led.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / TEXTS).cast("int").alias("parts"))
    plan = stage(splits.join(parts, "block"), "pattern_blocks")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda c, n: F.pmod(F.xxhash64(c, F.lit(7)), F.col(n)).cast("int")
    value = lambda own: (F.col("value") if own != by else F.lit(None).cast(kind)).alias("value")
    rows = join_small(placed, plan, "block", salt_by="pattern").select(
        "block", one("pattern", "splits").alias("split"), every("parts").alias("part"), F.lit(0).alias("role"), F.col("pattern").alias("string"), value("pattern")
    )
    rows = rows.unionByName(
        join_small(led, plan, "block", salt_by="text").select(
            "block", every("splits").alias("split"), one("text", "parts").alias("part"), F.lit(1).alias("role"), F.col("text").alias("string"), value("text")
        )
    )
    on = ["block", "split", "part"]
    met = rows.repartition(*on).sortWithinPartitions(*on, "role")

    def run(batches):
        import ahocorasick

        key, automaton, built, best = None, None, False, {}

        def given():
            values = pa.array([{"file_name": v[0], "file_path": v[1]} for v in best.values()], value_type)
            return pa.RecordBatch.from_arrays([pa.array(list(best), pa.string()), values], [by, "value"])

        value_type = pa.struct([("file_name", pa.string()), ("file_path", pa.string())])
        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in on)))
            for name, role, string, found in zip(names, batch.column("role").to_pylist(), batch.column("string").to_pylist(), batch.column("value").to_pylist()):
                if name != key:
                    key, automaton, built = name, ahocorasick.Automaton(), False
                if not role:  # patterns come first
                    automaton.add_word(string, (string, found and tuple(found.values())))
                    continue
                if not len(automaton):
                    continue
                if not built:
                    automaton.make_automaton()
                    built = True
                own = found and tuple(found.values())
                for _, (pattern, its) in automaton.iter(string):
                    entry, new = (pattern, own) if by == "pattern" else (string, its)
                    if entry not in best or new < best[entry]:
                        best[entry] = new
            if len(best) > HELD:
                yield given()
                best = {}
        yield given()

    fields = "struct<file_name:string,file_path:string>"
    found = met.mapInArrow(run, f"{by} string, value {fields}")
    return found.groupBy(by).agg(F.min("value").alias("value"))
