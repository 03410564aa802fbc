"""Approximate nearest neighbours by a forest of hash prefixes.

Every tree hashes a vector to a long string of symbols: each symbol names the nearest
of 128 random directions (64 and their opposites). A tree is the sorted array of the
strings, cut into parts by range; rows with one string are told apart by a mixed
number, so that a string that a third of all rows share still takes many parts.

A query first descends, in the first trees, to the longest prefix that enough rows of
its part share, whatever its length there. The scores found are a lower bound on those
of its neighbours, and with the chance that two vectors of such a score share a symbol
they tell how deep a prefix finds the wanted share of them. To that depth it then
ascends in all trees at once, and every row of the nodes reached is a candidate. A query
for which no prefix is safe, or whose prefixes too few rows share, meets all rows, in
one tree. Nothing is left out of a node.

Inner products become cosines by one more dimension, which fills shorter vectors up to
the longest length. Vectors that are alike are indexed once, with their least ids.
"""

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwise.llm.words import mix, sorted_groups
from leafwise.plans.joins import join_small
from leafwise.plans.staging import stage

TREES = 40
#: Trees in which a query descends; it ascends in all.
DESCENT = 16
#: Symbols of a string, random directions to choose from (each and its opposite), bits of a symbol.
SYMBOLS, DIRECTIONS, BITS = 8, 64, 7
#: Share of the neighbours that the chosen prefixes are expected to find.
RECALL = 0.92
#: Rows of a part that must share a prefix when a query descends.
LEAST = 64
#: Rows of a part, queries that meet it in one group, parts that a sample tells apart.
ROWS, QUERIES, CUTS = 8192, 8192, 2048
#: Rows of the sample from which parts are cut. It decides on balance only, not on results.
SAMPLE = 8192
SALTS = 64
HASHED_AT_ONCE = 2048


@lru_cache(maxsize=2)
def _directions(dim: int, trees: int, seed: int) -> list[np.ndarray]:
    """For each tree a matrix of random directions of ``dim + 1`` places."""
    return [np.random.default_rng((seed, dim, t)).standard_normal((dim + 1, SYMBOLS * DIRECTIONS), dtype=np.float32) for t in range(trees)]


def strings(points: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """Strings of all points (already filled up) in all trees, as numbers whose high bits are the first symbols."""
    out = np.empty((len(points), trees), dtype=np.int64)
    rows = points.astype(np.float32)
    for tree, directions in enumerate(_directions(points.shape[1] - 1, trees, seed)):
        near = (rows @ directions).reshape(len(rows), SYMBOLS, DIRECTIONS)
        best = np.abs(near).argmax(axis=2)
        against = np.take_along_axis(near, best[:, :, None], axis=2)[:, :, 0] < 0
        key = np.zeros(len(rows), dtype=np.int64)
        for s in range(SYMBOLS):
            key = (key << BITS) | (2 * best[:, s] + against[:, s])
        out[:, tree] = key
    return out


@lru_cache(maxsize=1)
def shared_symbol(samples: int = 40_000, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Cosines from 0 to 1 and the chance that vectors of that cosine share a symbol, by simulation."""
    random = np.random.default_rng(seed)
    one, other = random.standard_normal((2, samples, DIRECTIONS), dtype=np.float32)
    first = np.abs(one).argmax(axis=1)
    sign = np.take_along_axis(one, first[:, None], axis=1) > 0
    cosines = np.linspace(0, 1, 41)
    chances = []
    for c in cosines:
        two = c * one + np.sqrt(1 - c * c) * other
        best = np.abs(two).argmax(axis=1)
        chances.append(((best == first) & ((np.take_along_axis(two, best[:, None], axis=1) > 0) == sign)[:, 0]).mean())
    return cosines, np.maximum.accumulate(chances)


def safe_depth(cosines: np.ndarray, trees: int, recall: float) -> int:
    """The longest prefix by which at least ``recall`` of neighbours with these cosines are expected to be found."""
    chance = np.interp(cosines, *shared_symbol())
    for depth in range(SYMBOLS, 0, -1):
        if len(chance) and (1 - (1 - chance**depth) ** trees).mean() >= recall:
            return depth
    return 0


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _usable(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``id, v``: vectors with finite entries, not all zero."""
    chosen = rows.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{vector_column}`").alias("v"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return chosen.filter(F.col("id").isNotNull() & F.forall("v", fine) & F.exists("v", lambda x: x != 0))


def _norm() -> Column:
    return F.sqrt(F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def _classes(usable: DataFrame, keep: int) -> DataFrame:
    """``cls, v, ids``: the distinct vectors, each with its ``keep`` least ids.

    Copies are cut down in salted groups first, by each map task already.
    """
    salted = usable.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).distinct()
    least = Window.partitionBy("v", "salt").orderBy("id")
    few = salted.withColumn("n", F.row_number().over(least)).filter(F.col("n") <= keep)
    grouped = few.groupBy("v").agg(F.slice(F.sort_array(F.collect_list("id")), 1, keep).alias("ids"))
    return grouped.select(F.monotonically_increasing_id().alias("cls"), "v", "ids")


def _hashed(rows: DataFrame, longest: float, trees: int, seed: int, query: bool) -> DataFrame:
    """``cls, v, ids, dim, keys``: with the strings of each vector."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches):
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes):
                same = batch.take(pa.array(np.flatnonzero(sizes == dim)))
                for start in range(0, same.num_rows, HASHED_AT_ONCE):
                    part = same.slice(start, HASHED_AT_ONCE)
                    v = _matrix(part.column(1), dim)
                    norms = np.sqrt((v * v).sum(axis=1))
                    if query:
                        points = np.column_stack((v / norms[:, None], np.zeros(len(v))))
                    else:
                        points = np.column_stack((v / longest, np.sqrt(np.maximum(0, 1 - (norms / longest) ** 2))))
                    keys = strings(points, trees, seed)
                    edges = pa.array(np.arange(0, keys.size + 1, trees, dtype=np.int32))
                    lists = pa.ListArray.from_arrays(edges, pa.array(keys.ravel()))
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.array(np.full(len(v), dim, dtype=np.int32)), lists], ["cls", "v", "ids", "dim", "keys"]
                    )

    return rows.select("cls", "v", "ids").mapInArrow(run, f"cls long, v {kinds['v']}, ids {kinds['ids']}, dim int, keys array<long>")


class Parts:
    """How the sorted array of each tree is cut into parts.

    Cuts come from a sample of bounded size; a part beyond ``ROWS`` rows is dealt out
    over several by the rows' mixed numbers.
    """

    def __init__(self, sample: list, totals: dict[int, int], trees: int):
        self.cuts, self.deals = {}, {}
        by_dim: dict[int, list] = {}
        for dim, cls, keys in sample:
            by_dim.setdefault(dim, []).append((cls, keys))
        for dim, total in totals.items():
            found = by_dim.get(dim, [])
            wanted = max(1, -(-total // ROWS))
            parts = max(1, min(wanted, CUTS, len(found) // 4))
            self.deals[dim] = -(-wanted // parts)
            if parts > 1:
                salts = salt_of(np.array([c for c, _ in found], dtype=np.int64))
                keys = np.array([k for _, k in found], dtype=np.int64)
                at = np.arange(1, parts) * len(found) // parts
                orders = [np.lexsort((salts, keys[:, t]))[at] for t in range(trees)]
                self.cuts[dim] = [(keys[o, t], salts[o]) for t, o in enumerate(orders)]

    def of(self, dim: int, tree: int, keys: np.ndarray, salts: np.ndarray) -> np.ndarray:
        """The parts in which these rows lie."""
        if dim not in self.cuts:
            return np.zeros(len(keys), dtype=np.int64)
        cut_keys, cut_salts = self.cuts[dim][tree]
        begins = np.concatenate((np.ones(len(cut_keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)))
        order = np.lexsort((1 - begins, np.concatenate((cut_salts, salts)), np.concatenate((cut_keys, keys))))
        out = np.empty(len(order), dtype=np.int64)
        out[order] = np.cumsum(begins[order])
        return out[len(cut_keys) :]


def salt_of(numbers: np.ndarray) -> np.ndarray:
    return (mix(numbers.astype(np.uint64) + np.uint64(1)) >> np.uint64(1)).astype(np.int64)


ROUTED = "dim int, tree int, part long, kind int, key long, high long, cls long"
TOP_SALT = np.iinfo(np.int64).max


def _routed(hashed: DataFrame, parts: Parts, rule: str, trees: int) -> DataFrame:
    """Rows with the part they go to: stored ones (``stored``), queries on their way down or up.

    ``key`` and ``high`` bound the node that a query ascends to.
    """
    kinds = {f.name: f.dataType.simpleString() for f in hashed.schema}
    ascending = rule == "up"
    columns = ["cls", "v", "ids", "dim", "keys"] + ["depth"] * ascending

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            keys = batch.column("keys").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            cls = batch.column("cls").to_numpy(zero_copy_only=False)
            salts = salt_of(cls)
            depth = batch.column("depth").to_numpy(zero_copy_only=False) if ascending else np.full(len(cls), SYMBOLS)
            for tree in range(trees):
                for dim in np.unique(dims):
                    deals = parts.deals[int(dim)]
                    at = np.flatnonzero((dims == dim) & ((depth > 0) | (tree == 0)))
                    shift = BITS * (SYMBOLS - depth[at])
                    low = (keys[at, tree] >> shift) << shift
                    high = low + (np.int64(1) << shift) - 1
                    if rule == "up":
                        first = parts.of(dim, tree, low, np.full(len(at), -1))
                        last = parts.of(dim, tree, high, np.full(len(at), TOP_SALT))
                        span = (last - first + 1) * deals
                        row = np.repeat(np.arange(len(at)), span)
                        part = first[row] * deals + np.arange(len(row)) - np.repeat(np.cumsum(span) - span, span)
                    else:
                        row = np.arange(len(at))
                        part = parts.of(dim, tree, low, salts[at]) * deals + salts[at] % deals
                    for a in range(0, len(row), HASHED_AT_ONCE):
                        chosen, to = row[a : a + HASHED_AT_ONCE], part[a : a + HASHED_AT_ONCE]
                        n = len(chosen)
                        rows = pa.array(at[chosen])
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(n, dim, dtype=np.int32)),
                                pa.array(np.full(n, tree, dtype=np.int32)),
                                pa.array(to),
                                pa.array(np.full(n, int(rule == "stored"), dtype=np.int32)),
                                pa.array(low[chosen]),
                                pa.array(high[chosen]),
                                pa.array(cls[at[chosen]]),
                                batch.column("v").take(rows),
                                batch.column("ids").take(rows),
                            ],
                            ["dim", "tree", "part", "kind", "key", "high", "cls", "v", "ids"],
                        )

    return hashed.select(*columns).mapInArrow(run, f"{ROUTED}, v {kinds['v']}, ids {kinds['ids']}")


def _met(stored: DataFrame, asked: DataFrame) -> DataFrame:
    """Stored rows and queries of a part together; queries of a crowded part take several groups."""
    on = ["dim", "tree", "part"]
    crowds = asked.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("blocks")).filter("blocks > 1")
    crowds = stage(crowds, "crowded_parts")
    if crowds.isEmpty():
        both = stored.withColumn("block", F.lit(0)).unionByName(asked.withColumn("block", F.lit(0)))
    else:
        blocks = F.coalesce("blocks", F.lit(1))
        every = F.explode(F.sequence(F.lit(0), blocks - 1))
        more = join_small(stored, crowds, on, salt_by="cls", how="left").withColumn("block", every).drop("blocks")
        dealt = join_small(asked, crowds, on, salt_by="cls", how="left")
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("cls"), blocks).cast("int")).drop("blocks")
        both = more.unionByName(dealt)
    return both.repartition(*on, "block").sortWithinPartitions(*on, "block", "kind", "key")


def _best(queries: np.ndarray, rows: np.ndarray, keep: int):
    """For each query the places of its ``keep`` best rows, with all that tie, and their exact products."""
    rough = queries @ rows.T
    slack = 1e-9 * np.sqrt((queries * queries).sum(axis=1) * max((rows * rows).sum(axis=1).max(initial=0), 1e-300))
    for i in range(len(queries)):
        if len(rows) > keep:
            least = np.partition(rough[i], len(rows) - keep)[len(rows) - keep]
            at = np.flatnonzero(rough[i] >= least - slack[i])
        else:
            at = np.arange(len(rows))
        yield i, at, (queries[i] * rows[at]).sum(axis=1)


def _searched(met: DataFrame, keep: int, down: bool) -> DataFrame:
    """``q, own, norm, cls, scores, ids``: the best rows of a part for each query there; ids only on the way up."""
    kind = met.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        for (dim, tree, part, block), group in sorted_groups(batches, ["dim", "tree", "part", "block"]):
            which = group.column("kind").to_numpy()
            asked, rows = group.filter(pa.array(which == 0)), group.filter(pa.array(which == 1))
            if not asked.num_rows or not rows.num_rows:
                continue
            keys = rows.column("key").to_numpy()  # sorted
            v, q = (_matrix(x.column("v").combine_chunks(), dim) for x in (rows, asked))
            cls, ids = rows.column("cls").to_numpy(), rows.column("ids").combine_chunks()
            low, high = asked.column("key").to_numpy(), asked.column("high").to_numpy()
            begin, end = np.searchsorted(keys, low), np.searchsorted(keys, high, side="right")
            if down:  # the longest prefix that enough rows share
                full = end - begin >= min(LEAST, len(keys))
                for depth in range(SYMBOLS - 1, -1, -1):
                    shift = BITS * (SYMBOLS - depth)
                    node = (low >> shift) << shift
                    b = np.searchsorted(keys, node)
                    e = np.searchsorted(keys, node + (1 << shift) - 1, side="right")
                    begin, end = np.where(full, begin, b), np.where(full, end, e)
                    full |= end - begin >= min(LEAST, len(keys))
            names, own = asked.column("cls").to_numpy(), asked.column("ids").combine_chunks()
            norms = np.sqrt((q * q).sum(axis=1))
            found = []
            order = np.lexsort((end, begin))
            edges = np.flatnonzero((np.diff(begin[order]) != 0) | (np.diff(end[order]) != 0)) + 1
            for same in np.split(order, edges):
                b, e = begin[same[0]], end[same[0]]
                for a in range(0, len(same), 512):
                    some = same[a : a + 512]
                    found += [(some[i], b + at, scores) for i, at, scores in _best(q[some], v[b:e], keep)]
            found = [x for x in found if len(x[1])]
            if not found:
                continue
            edges = pa.array(np.concatenate(([0], np.cumsum([len(at) for _, at, _ in found]))).astype(np.int32))
            at, who = np.concatenate([x[1] for x in found]), np.array([x[0] for x in found])
            lists = lambda values, edges=edges: pa.ListArray.from_arrays(edges, values)
            none = pa.array([None] * len(found), pa.list_(ids.type))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names[who]),
                    own.take(pa.array(who)).flatten(),
                    pa.array(norms[who]),
                    lists(pa.array(cls[at])),
                    lists(pa.array(np.concatenate([x[2] for x in found]))),
                    none if down else lists(ids.take(pa.array(at))),
                ],
                ["q", "own", "norm", "cls", "scores", "ids"],
            )

    found = met.mapInArrow(run, f"q long, own {kind}, norm double, cls array<long>, scores array<double>, ids array<array<{kind}>>")
    return found.repartition("q").sortWithinPartitions("q")


def _depths(found: DataFrame, k: int, longest: float, trees: int, recall: float) -> DataFrame:
    """``cls, depth``: how far up each query goes, from the best scores it met on its way down."""

    def run(batches):
        for (q,), group in sorted_groups(batches, ["q"]):
            cls = group.column("cls").combine_chunks().flatten().to_numpy()
            scores = group.column("scores").combine_chunks().flatten().to_numpy()
            best = -np.sort(-scores[np.unique(cls, return_index=True)[1]])[1 : k + 1]  # the first is, as a rule, its own
            cosines = np.clip(best / (group.column("norm")[0].as_py() * longest), 0, 1)
            depth = safe_depth(cosines, trees, recall) if len(best) == k else 0
            yield pa.RecordBatch.from_arrays([pa.array([q], pa.int64()), pa.array([depth], pa.int32())], ["cls", "depth"])

    return found.mapInArrow(run, "cls long, depth int")


def _ranked(found: DataFrame, k: int, keep: int) -> DataFrame:
    """``q, query_id, rank, vec_id, score`` from what each query found in all parts."""
    kind = found.schema["own"].dataType.simpleString()

    def run(batches):
        for (q,), group in sorted_groups(batches, ["q"]):
            own = group.column("own")[0].as_py()
            cls = group.column("cls").combine_chunks().flatten().to_numpy()
            scores = group.column("scores").combine_chunks().flatten().to_numpy()
            ids = group.column("ids").combine_chunks().flatten()
            once = np.unique(cls, return_index=True)[1]
            if len(once) > keep:
                least = np.partition(scores[once], len(once) - keep)[len(once) - keep]
                once = once[scores[once] >= least]
            pairs = sorted((-s, i) for s, each in zip(scores[once].tolist(), ids.take(pa.array(once)).to_pylist()) for i in each)
            best = [(i, -s) for s, i in pairs if i != own][:k]
            n = len(best)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([q] * n, pa.int64()),
                    pa.array([own] * n, group.schema.field("own").type),
                    pa.array(range(1, n + 1), pa.int32()),
                    pa.array([i for i, _ in best], group.schema.field("own").type),
                    pa.array([s for _, s in best], pa.float64()),
                ],
                ["q", "query_id", "rank", "vec_id", "score"],
            )

    return found.mapInArrow(run, f"q long, query_id {kind}, rank int, vec_id {kind}, score double")


def _ascended(stored: DataFrame, climbing: DataFrame, parts: Parts, trees: int, k: int, keep: int) -> DataFrame:
    met = _met(_routed(stored, parts, "stored", trees), _routed(climbing, parts, "up", trees))
    return _ranked(_searched(met, keep, down=False), k, keep)


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    trees: int = TREES,
    recall: float = RECALL,
    seed: int = 5,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of largest inner product found for each row of ``queries``.

    Scores are products of the original vectors in double precision; equal ones are
    ordered by id. A row is no neighbour of its own id. A query meets vectors of its
    length only; with fewer candidates it gets all of them.

    Rows with a null id, and vectors that are null, empty, zero or hold null or
    non-finite entries, take no part. Rows that repeat id and vector count once. An id
    with several vectors is asked for each of them. Empty tables give no rows. Other
    columns are left out.
    """
    usable = _usable(vectors, id_column, vector_column)
    asked = _usable(queries, id_column, vector_column).distinct()
    kind = usable.schema["id"].dataType.simpleString()
    extra = usable.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    keep = k + extra
    classes = stage(_classes(usable, keep), "distinct_vectors")
    about = classes.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(_norm()).alias("longest")).collect()
    if not about:
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    totals = {r["dim"]: r["n"] for r in about}
    longest = max(r["longest"] for r in about)
    stored = stage(_hashed(classes, longest, trees, seed, query=False), "hashed_vectors")
    known = asked.filter(F.size("v").isin(list(totals))).select(F.monotonically_increasing_id().alias("cls"), "v", F.array("id").alias("ids"))
    wanted = stage(_hashed(stage(known, "queries"), longest, trees, seed, query=True), "hashed_queries")
    total = sum(totals.values())
    sample = stored if total <= SAMPLE else stored.sample(SAMPLE / total, seed=seed)
    parts = Parts([(r["dim"], r["cls"], r["keys"]) for r in sample.select("dim", "cls", "keys").limit(2 * SAMPLE).collect()], totals, trees)

    some = min(trees, DESCENT)
    down = _met(_routed(stored, parts, "stored", some), _routed(wanted, parts, "down", some))
    depths = stage(_depths(_searched(down, keep, down=True), k, longest, trees, recall), "depths")
    climbing = stage(wanted.join(depths, "cls", "left").withColumn("depth", F.coalesce("depth", F.lit(0))), "climbing")
    needed = trees if climbing.filter("depth > 0").limit(1).count() else 1
    found = stage(_ascended(stored, climbing, parts, needed, k, keep), "found")
    counts = found.groupBy("q").agg(F.count(F.lit(1)).alias("n"))
    short = climbing.filter("depth > 0").join(counts, climbing["cls"] == counts["q"], "left").filter(F.coalesce("n", F.lit(0)) < k).drop("q", "n")
    short = stage(short.withColumn("depth", F.lit(0)), "short")
    if not short.isEmpty():  # too few rows share their prefixes: all rows, then
        rest = found.join(short.select(F.col("cls").alias("q")), "q", "left_anti")
        found = rest.unionByName(_ascended(stored, short, parts, 1, k, keep))
    return found.drop("q")
