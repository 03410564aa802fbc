"""A Merkle manifest of a dataset, with one proof per row from octopus multiproofs.

Rows are leaves. Every group (source) has a tree over its rows in order of id, and the
trees' roots are the leaves of a top tree. Rows are numbered by a range partitioning
and counts per partition, so a large source is spread over all tasks.

Leaves lie in aligned blocks of ``3 ** LEVELS``, the leaf partitions. Proofs of all
leaves of a block need the same few nodes that the block cannot derive itself: the
octopus multiproof. A block works out their coordinates, they are fetched from the
stored nodes in one join, and the block then derives its interior nodes and expands
the proof of each of its leaves locally.
"""

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwise.llm.words import sorted_groups
from leafwise.plans.joins import join_small
from leafwise.plans.staging import stage

#: Children of a node.
WIDTH = 3
#: Levels of a block: 2187 leaves.
LEVELS = 7
#: Columns of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Name of the tree over the groups' roots; no group has it, as theirs hold "-" or ":".
TOP = ""
NODES = "tree string, level int, pos long, digest string, size long, is_root boolean"


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest_of(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, values)).cast("binary"), 256)


def joint(digests: list[str]) -> str:
    """The digest of a run of nodes."""
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def counts_of(size: int) -> list[int]:
    """Nodes of each level of a tree with ``size`` leaves, from the leaves to the root."""
    counts = [size]
    while counts[-1] > 1:
        counts.append(-(-counts[-1] // WIDTH))
    return counts


def siblings(place: int, count: int) -> tuple[list[int], list[int]]:
    """The other places of a node's run: those to its left and to its right."""
    first = place - place % WIDTH
    return list(range(first, place)), list(range(place + 1, min(first + WIDTH, count)))


def levels_above(digests: list[str], most: int) -> list[list[str]]:
    """Levels over a run of nodes that begins a block, lowest first, at most ``most`` of them."""
    levels = [digests]
    while len(levels) <= most:
        low = levels[-1]
        levels.append([joint(low[i : i + WIDTH]) for i in range(0, len(low), WIDTH)])
    return levels


def numbered(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` with their place ``pos`` (from 0) in their ``tree`` and its ``size``.

    The order begins with the trees. Rows are sorted by range, so that one large tree
    takes many tasks; rows that are alike in ``order`` are spread by where they were read.
    """
    by = [*order, F.col("read_at")]
    ranged = rows.withColumn("read_at", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    placed = ranged.drop("read_at").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    placed = stage(placed, "placed")
    counted = placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    tree = Window.partitionBy("tree")  # a row for each part
    before = F.coalesce(F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counted.select("tree", "part", (F.col("first") - before).alias("shift"), F.sum("n").over(tree).alias("size"))
    joined = join_small(placed, stage(shifts, "shifts"), ["tree", "part"], salt_by="at")
    return joined.withColumn("pos", F.col("at") - F.col("shift")).drop("part", "at", "shift")


def stored_nodes(leaves: DataFrame, whole: bool, height: int) -> DataFrame:
    """Nodes of all trees of ``leaves`` (``tree, size, pos, digest``).

    Blocks of nodes are worked through ``height`` levels at a time. With ``whole`` all
    nodes are returned, else those that no leaf block can derive: from its top upwards.
    """
    found, base = None, 0
    most = leaves.agg(F.max("size")).first()[0] or 0
    nodes = leaves.select("tree", F.lit(0).alias("level"), "pos", "digest", "size")
    while True:
        dealt = nodes.withColumn("block", F.expr(f"pos div {WIDTH**height}"))
        dealt = dealt.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")

        def grow(batches, base=base):
            for (tree, number), group in sorted_groups(batches, ["tree", "block"]):
                size = group.column("size")[0].as_py()
                left = len(counts_of(size)) - 1 - base  # levels above these nodes
                levels = levels_above(group.column("digest").to_pylist(), min(height, left))
                first = 0 if whole and base == 0 else 1 if base else len(levels) - 1
                for level in range(first, len(levels)):
                    n = len(levels[level])
                    at = number * WIDTH ** (height - level)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([tree] * n, pa.string()),
                            pa.array([base + level] * n, pa.int32()),
                            pa.array(range(at, at + n), pa.int64()),
                            pa.array(levels[level], pa.string()),
                            pa.array([size] * n, pa.int64()),
                            pa.array([level == left] * n, pa.bool_()),
                        ],
                        ["tree", "level", "pos", "digest", "size", "is_root"],
                    )

        made = stage(dealt.mapInArrow(grow, NODES), "nodes")
        found = made if found is None else found.unionByName(made)
        base += height
        if -(-most // WIDTH**base) <= 1:
            return found
        nodes = made.filter((F.col("level") == base) & (F.col("size") > WIDTH**base))


def _missing(blocks: DataFrame, height: int) -> DataFrame:
    """``tree, block, of, level, pos``: nodes that proofs of a block need and that it cannot derive.

    Also the root of the top tree, against which the proofs are verified.
    """

    def coordinates(batches):
        for batch in batches:
            rows = []
            for tree, block, size, rank, groups in zip(*(batch.column(c).to_pylist() for c in ("tree", "block", "size", "rank", "groups"))):
                counts = counts_of(size)
                for level in range(height, len(counts) - 1):
                    left, right = siblings(block // WIDTH ** (level - height), counts[level])
                    rows += [(tree, block, tree, level, p) for p in left + right]
                counts = counts_of(groups)
                for level in range(len(counts) - 1):
                    left, right = siblings(rank // WIDTH**level, counts[level])
                    rows += [(tree, block, TOP, level, p) for p in left + right]
                rows.append((tree, block, TOP, len(counts) - 1, 0))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["tree", "block", "of", "level", "pos"])

    return blocks.mapInArrow(coordinates, "tree string, block long, of string, level int, pos long")


def _folded(digest: str, place: int, runs: list[tuple[list[str], list[str]]]) -> str:
    for left, right in runs:
        digest = joint([*left, digest, *right])
    return digest


def _expand(proofs, most, batches):
    """Task function: proofs of the leaves of each block, from its leaves and the nodes fetched for it."""
    names = ["id", "digest", "subroot", "root", "proof", "proof_sha256", "folded_root", "verified"]
    for (tree, block), group in sorted_groups(batches, ["tree", "block"]):
        fetched = group.filter(pc.field("of").is_valid())
        rows = group.filter(pc.field("of").is_null()).sort_by("pos")
        known = {(o, n, p): d for o, n, p, d in zip(*(fetched.column(c).to_pylist() for c in ("of", "level", "pos", "digest")))}
        size, rank, groups = (rows.column(c)[0].as_py() for c in ("size", "rank", "groups"))
        counts = counts_of(size)
        own = levels_above(rows.column("digest").to_pylist(), min(most, len(counts) - 1))
        height = len(own) - 1

        def runs(of, place, levels, counts):
            found = []
            for level in levels:
                left, right = siblings(place // WIDTH ** (level - levels.start), counts[level])
                found.append(([known[of, level, p] for p in left], [known[of, level, p] for p in right]))
            return found

        inside = runs(tree, block, range(height, len(counts) - 1), counts)
        top = counts_of(groups)
        above = runs(TOP, rank, range(len(top) - 1), top)
        root = known[TOP, len(top) - 1, 0]
        subroot = _folded(own[height][0], block, inside)
        whole = _folded(subroot, rank, above)
        # siblings of a node and of all above it, from the block's top down
        paths = ["".join("".join(left + right) for left, right in inside + above)]
        for level in range(height - 1, -1, -1):
            low, count = own[level], len(own[level])
            next_paths = []
            for i in range(count):
                left, right = siblings(i, count)
                next_paths.append("".join([low[p] for p in left + right]) + paths[i // WIDTH])
            paths = next_paths
        folded = []
        for i, (leaf, shown) in enumerate(zip(own[0], rows.column("shown").to_pylist())):
            if shown == leaf:
                folded.append(whole)  # its way up is the one just derived
                continue
            digest = shown
            for level in range(height):
                place = i // WIDTH**level
                left, right = siblings(place, len(own[level]))
                digest = joint([*(own[level][p] for p in left), digest, *(own[level][p] for p in right)])
            folded.append(_folded(digest, block, inside + above))
        n = len(folded)
        yield pa.RecordBatch.from_arrays(
            [
                rows.column("id").combine_chunks(),
                rows.column("digest").combine_chunks(),
                pa.array([subroot] * n, pa.string()),
                pa.array([root] * n, pa.string()),
                pa.array(paths if proofs else [None] * n, pa.string()),
                pa.array([hashlib.sha256(p.encode()).hexdigest() for p in paths], pa.string()),
                pa.array(folded, pa.string()),
                pa.array([f == root for f in folded], pa.bool_()),
            ],
            names,
        )


def merkle_manifest(
    documents: DataFrame,
    shown: dict[str, Column] | None = None,
    fields: tuple[str, ...] = FIELDS,
    id_column: str = "doc_id",
    group_column: str = "source",
    proofs: bool = False,
    levels: int = LEVELS,
) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    ``shown`` gives columns of the rows as they are shown for verification, where they
    differ; ``folded_root`` comes from that leaf and the original siblings. With
    ``proofs`` the siblings' digests are returned, too, joined in order (``proof``). Blocks have ``levels`` levels.

    A null field is ``-`` in its leaf, an empty one ``0:``. Rows without a group make a
    group of their own, the first. Leaves are ordered by id, null first, and rows with
    one id by their digest; rows that repeat are leaves each, with proofs of their own.
    An empty table gives no rows. Other columns are not part of a leaf.
    """
    column = lambda c: F.col(f"`{c}`")
    leaf = digest_of([column(c) for c in fields])
    other = digest_of([(shown or {}).get(c, column(c)) for c in fields])
    group = column(group_column)
    rows = documents.select(column(id_column).alias("id"), group.alias("source"), encoded(group).alias("tree"), leaf.alias("digest"), other.alias("shown"))
    leaves = numbered(rows, [F.asc_nulls_first("source"), F.asc_nulls_first("id"), F.asc("digest")])
    leaves = stage(leaves, "leaves")
    nodes = stored_nodes(leaves, False, levels)
    sizes = leaves.groupBy("tree").agg(F.min("source").alias("source"), F.max("size").alias("size"))
    ranked = numbered(sizes.select(F.col("tree").alias("group"), "source", F.lit(TOP).alias("tree"), F.col("size").alias("leaves")), [F.asc_nulls_first("source")])
    ranked = stage(ranked.select(F.col("group").alias("tree"), F.col("leaves").alias("size"), F.col("pos").alias("rank"), F.col("size").alias("groups")), "groups")
    roots = nodes.filter("is_root").select("tree", "digest")
    tops = ranked.join(roots, "tree").select(F.lit(TOP).alias("tree"), F.col("groups").alias("size"), F.col("rank").alias("pos"), "digest")
    nodes = nodes.unionByName(stored_nodes(stage(tops, "subroots"), True, levels)).select(F.col("tree").alias("of"), "level", "pos", "digest")

    block = WIDTH**levels
    blocks = ranked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {block}"))))
    needed = join_small(_missing(blocks, levels), nodes, ["of", "level", "pos"], salt_by="block")
    none = lambda kind: F.lit(None).cast(kind)
    kind = leaves.schema["id"].dataType.simpleString()
    needed = needed.select(
        "tree", "block", "of", "level", "pos", "digest", none(kind).alias("id"), none("string").alias("shown"), *(none("long").alias(c) for c in ("size", "rank", "groups"))
    )
    placed = join_small(leaves.drop("size"), ranked, "tree", salt_by="pos").select(
        "tree", F.expr(f"pos div {block}").alias("block"), none("string").alias("of"), none("int").alias("level"), "pos", "digest", "id", "shown", "size", "rank", "groups"
    )
    both = placed.unionByName(needed).repartition("tree", "block").sortWithinPartitions("tree", "block")
    schema = f"id {kind}, digest string, subroot string, root string, proof string, proof_sha256 string, folded_root string, verified boolean"
    done = both.mapInArrow(lambda batches: _expand(proofs, levels, batches), schema)
    named = done.withColumnsRenamed({"id": "doc_id", "digest": "leaf"})
    return named if proofs else named.drop("proof")
