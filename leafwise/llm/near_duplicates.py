"""Near-duplicate documents by SuperMinHash signatures, banding, verification and union-find.

A document's set holds its distinct word shingles. SuperMinHash gives every element
a random permutation of the signature's places and a random fraction; place ``j`` of
the signature is the least ``rank + fraction`` over the elements. As the ranks of an
element are a permutation, the places are correlated in a way that lowers the
variance. The ranks are worked through in order for all elements at once: after rank
``k`` every place reached so far is final, so a document stops as soon as all its
places are reached, usually after one or two ranks.

Documents with one set form a class, and only classes are compared. Classes that
share a band of the signature are candidates. Each is first compared with the
smallest class of the band, then with those classes of the band to which no chain of
links leads yet. Links are confirmed on full sets, and the components are found by
local union-find and star contractions.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwise.llm import blooms
from leafwise.llm.words import U64, as_bytes, hash_windows, hash_words, mix, released, slices, sorted_groups, split_words
from leafwise.plans.joins import fits_broadcast, join_small
from leafwise.plans.staging import stage

#: Words of a shingle.
WIDTH = 5
#: Bands and signature places in each: of pairs with similarity 0.85, about 1 in 4 million meets in no band.
BANDS, ROWS = 26, 5
#: Candidates whose signatures agree in fewer places are given up: over six standard
#: deviations below what a similarity of 0.85 leads to.
AGREEMENT = 80
#: Classes of a band, and shingles of them, that are compared with each other in one task.
BLOCK, SHINGLES = 1024, 1 << 20
#: Rows of a class from which on its rows are joined apart from the others.
COPIES = 1000
#: Members of a band's smallest class that are verified in one group.
MEMBERS = 512


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of all texts, and where each text's begin (plus the end).

    A text of fewer words has its whole sequence as its only shingle, one without
    words none. Within a text the hashes are sorted.
    """
    words = split_words(texts, lower=True)
    hashes = hash_words(words)
    counts = words.counts
    own = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    begins = np.concatenate(([0], np.cumsum(own)))
    text = np.repeat(np.arange(len(counts)), own)
    starts = words.first[:-1][text] + np.arange(begins[-1]) - begins[text]
    out = np.empty(begins[-1], dtype=U64)
    long = counts[text] >= width
    out[long] = hash_windows(hashes, starts[long], width)
    for n in range(1, width):  # short texts
        short = counts[text] == n
        if short.any():
            out[short] = hash_windows(hashes, starts[short], n, seed=100 * n)
    order = np.lexsort((out, text))
    out, text = out[order], text[order]
    fresh = np.ones(len(out), dtype=bool)
    fresh[1:] = (out[1:] != out[:-1]) | (text[1:] != text[:-1])
    out, text = out[fresh], text[fresh]
    return out, np.searchsorted(text, np.arange(len(counts) + 1))


def superminhash(elements: np.ndarray, begins: np.ndarray, places: int) -> np.ndarray:
    """Signatures of all sets: ``rank << 48 | fraction`` for each place; an empty set has all bits."""
    sets = len(begins) - 1
    empty = ~U64(0)
    flat = np.full(sets * places, empty, dtype=U64)
    owner = np.repeat(np.arange(sets), np.diff(begins))
    live, state = np.arange(len(elements)), elements.copy()
    order = None  # the elements' permutations, once a second rank is needed
    for rank in range(places):
        state = mix(state + U64(0x9E3779B97F4A7C15))
        fraction = state >> U64(16)
        swap = rank + ((state & U64(0xFFFF)) * U64(places - rank) >> U64(16)).astype(np.int64)
        if rank == 0:
            place = swap
        else:
            at = np.arange(len(live))
            place = order[at, swap].astype(np.int64)
            order[at, swap] = order[at, rank]
            order[at, rank] = place
        np.minimum.at(flat, owner[live] * places + place, (U64(rank) << U64(48)) | fraction)
        open_sets = (flat.reshape(sets, places) == empty).any(axis=1)
        stay = open_sets[owner[live]]
        if not stay.any():
            break
        if rank == 0:
            live, state, swap = live[stay], state[stay], swap[stay]
            order = np.tile(np.arange(places, dtype=np.int16), (len(live), 1))
            at = np.arange(len(live))
            order[at, swap] = 0
            order[at, 0] = swap
        elif not stay.all():
            live, state, order = live[stay], state[stay], order[stay]
    return flat.reshape(sets, places)


def _classes(elements: np.ndarray, begins: np.ndarray) -> list[bytes | None]:
    """A digest of each set, none of an empty one."""
    packed = elements.astype("<u8")
    return [
        hashlib.blake2b(packed[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(begins[:-1], begins[1:])
    ]


def _signed(documents: DataFrame, id_column: str, text_column: str, bands: int, rows: int, carry: tuple[str, ...]) -> DataFrame:
    """``doc_id, text_key, n_shingles, class, bands, brief`` of each document, and what is carried."""
    carried = [f"carried {c}" for c in carry]
    kind = documents.schema[id_column].dataType.simpleString()
    places = bands * rows
    factors = mix(np.arange(1, places + 1, dtype=U64)).reshape(bands, rows) | U64(1)

    def sign(batches):
        for batch in batches:
            texts = as_bytes(batch.column(2))
            for a, b in slices(texts, 1 << 20):
                elements, begins = shingle_sets(texts[a:b])
                n = np.diff(begins)
                signature = superminhash(elements, begins, places)
                keys = mix((signature.reshape(-1, bands, rows) * factors).sum(axis=2, dtype=U64) + np.arange(bands, dtype=U64))
                brief = (mix(signature) >> U64(48)).astype("<u2")
                classes, band_lists, briefs = _classes(elements, begins), [], []
                for i in range(b - a):
                    if n[i]:
                        band_lists.append(keys[i].view(np.int64))
                        briefs.append(brief[i].tobytes())
                    else:
                        band_lists.append(None)
                        briefs.append(None)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(n.astype(np.int64)),
                        pa.array(classes, pa.binary()),
                        pa.array(band_lists, pa.list_(pa.int64())),
                        pa.array(briefs, pa.binary()),
                        *(part.column(c) for c in carried),
                    ],
                    ["doc_id", "text_key", "n_shingles", "class", "bands", "brief", *carried],
                )

    text = F.col(f"`{text_column}`")
    chosen = documents.select(
        F.col(f"`{id_column}`").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"), *(F.col(f"`{c}`").alias(f"carried {c}") for c in carry)
    )
    more = "".join(f", `{c}` {chosen.schema[c].dataType.simpleString()}" for c in carried)
    return chosen.mapInArrow(released(sign), f"doc_id {kind}, text_key long, n_shingles long, class binary, bands array<long>, brief binary{more}")


def _agreeing(pairs: DataFrame, wanted: DataFrame, percent: int, least: int) -> DataFrame:
    """Pairs ``a, b`` whose signatures agree in ``least`` places or more and whose sizes allow a link."""

    def keep(batches):
        for batch in batches:
            one, two = (
                np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype="<u2").reshape(batch.num_rows, -1) for k in (2, 3)
            )
            mask = (one == two).sum(axis=1) >= least
            yield batch.select(["a", "b"]).filter(pa.array(mask))

    one, two = (
        wanted.select(F.col("class").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("brief").alias(f"brief_{k}")) for k in ("a", "b")
    )
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    both = pairs.join(one, "a").join(two, "b").filter(sizes).select("a", "b", "brief_a", "brief_b")
    return both.mapInArrow(keep, "a binary, b binary")


def _linked(pairs: DataFrame, wanted: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Staged pairs whose full sets are similar: ``100 * intersection >= percent * union``.

    ``b`` of a pair may have many partners. Its text goes once to each group of about
    ``MEMBERS`` of them, in which the partners' texts stream past.
    """
    many = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MEMBERS)
    salts = F.ceil(F.coalesce("n", F.lit(1)) / MEMBERS)
    salted = pairs.join(many, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), salts).cast("int").alias("salt"))
    salted = stage(salted, "salted_pairs")
    roles = salted.select(F.col("a").alias("class"), "b", "salt", F.lit(1).alias("role")).unionByName(
        salted.select(F.col("b").alias("class"), "b", "salt", F.lit(0).alias("role")).distinct()
    )
    packed = _packed(wanted.join(roles.select("class"), "class", "left_semi"), texts)
    placed = roles.join(packed, "class").repartition("b", "salt").sortWithinPartitions("b", "salt", "role", "class")

    def verify(batches):
        key, base = None, None
        for batch in batches:
            found = []
            rows = zip(*(batch.column(k).to_pylist() for k in ("b", "salt", "role", "class")))
            for (b, salt, role, name), own in zip(rows, _unpacked(batch)):
                if (b, salt) != key:  # the group's own set comes first
                    key, base = (b, salt), own.copy()
                if role:
                    at = np.searchsorted(base, own)
                    at[at == len(base)] = 0
                    shared = int((base[at] == own).sum())
                    if 100 * shared >= percent * (len(base) + len(own) - shared):
                        found.append((name, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], ["a", "b"])

    return stage(placed.mapInArrow(released(verify), "a binary, b binary"), "star_links")


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links`` (``a, b``): label is its component's least node.

    Each task first unites the links it has by union-find, which leaves a star per
    component it sees. Then large and small stars alternate (every node links its
    neighbours to the least of them) until nothing changes. All steps are joins and
    groupings with partial sums; no list of neighbours is ever built. Each round is
    written to the shared folder.
    """

    def unite(batches):
        parent: dict[bytes, bytes] = {}

        def root(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent.setdefault(up, up)
                x = parent[x]
            return x

        def stars():
            nodes = [x for x in parent if root(x) != x]
            return pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.binary()), pa.array([root(x) for x in nodes], pa.binary())], ["u", "v"]
            )

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > 1_000_000:
                yield stars()
                parent.clear()
        yield stars()

    def facts(df):
        mark = F.xxhash64("u", "v").cast("decimal(20,0)")
        return df.agg(F.count(F.lit(1)), F.sum(mark)).first()

    edges = stage(links.select("a", "b").mapInArrow(unite, "u binary, v binary").distinct(), "edges")
    before = facts(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.distinct(), "large_stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small_stars")
        after = facts(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )


def _packed(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """``class, packed, raw``: a compressed text of each ``wanted`` class, and maybe of a few others.

    Texts are a third of the hashes of their shingles, of which sets are made again
    where they are compared. ``texts`` has ``doc_id, text_key, text``; a class is made
    out of the text, so nothing has to be joined to find it.
    """

    def pack(batches):
        codec = pa.Codec("zstd", compression_level=3)
        for batch in batches:
            every = as_bytes(batch.column("text"))
            for a, b in slices(every, 1 << 20):
                classes = _classes(*shingle_sets(every[a:b]))
                some = [i for i, name in enumerate(classes) if name is not None]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([classes[i] for i in some], pa.binary()),
                        pa.array([codec.compress(every[a + i], asbytes=True) for i in some], pa.binary()),
                        pa.array([len(every[a + i]) for i in some], pa.int64()),
                    ],
                    ["class", "packed", "raw"],
                )

    mark = F.xxhash64("doc_id", "text_key")
    wanted = wanted.select("doc_id", "text_key")
    blocks = blooms.blocks_for(wanted.count())
    few = blooms.marked(texts, mark, blooms.bloom_of(wanted, mark, blocks), blocks).filter("maybe").select("text")
    made = few.mapInArrow(released(pack), "class binary, packed binary, raw long")
    # rows may repeat; the first of each class is enough
    return made.groupBy("class").agg(F.first(F.struct("packed", "raw")).alias("one")).select("class", "one.packed", "one.raw")


def _unpacked(rows: pa.RecordBatch | pa.Table):
    """The set of each row of ``packed, raw``, made for a few texts at a time."""
    codec = pa.Codec("zstd")
    packed, raw = (rows.column(c).to_pylist() for c in ("packed", "raw"))

    def sets(begin, end):
        elements, begins = shingle_sets([codec.decompress(packed[i], raw[i], asbytes=True) for i in range(begin, end)])
        return (elements[begins[i] : begins[i + 1]] for i in range(end - begin))

    begin, size = 0, 0
    for i, n in enumerate(raw):
        if i > begin and size + n > 1 << 20:
            yield from sets(begin, i)
            begin, size = i, 0
        size += n
    if raw:
        yield from sets(begin, len(raw))


def _partners(i: int, group: dict, percent: int, least: int) -> np.ndarray:
    """Rows that row ``i`` of a group has to be compared with, the most alike first."""
    label, size, keys, brief = (group[c] for c in ("label", "size", "keys", "brief"))
    right = group["right"]
    j = right[(label[right] != label[i]) & (right > i if group["one"] == group["two"] else True)]
    j = j[100 * np.minimum(size[j], size[i]) >= percent * np.maximum(size[j], size[i])]
    earlier = group["earlier"]
    j = j[~(keys[j, :earlier] == keys[i, :earlier]).any(axis=1)]
    alike = (brief[j] == brief[i]).sum(axis=1)
    return j[np.argsort(-alike, kind="stable")][: int((alike >= least).sum())]


def _arrays(key: int, one: int, two: int, rows: pa.Table) -> dict:
    """The columns of a group by which partners are chosen."""
    own = rows.column("own").to_numpy()
    keys = np.array(rows.column("bands").to_pylist(), dtype=np.int64)
    return {
        "one": one,
        "two": two,
        "own": own,
        "left": np.flatnonzero(own == one),
        "right": np.flatnonzero(own == two),
        "label": np.unique(np.array([x.hex() for x in rows.column("label").to_pylist()]), return_inverse=True)[1],
        "size": rows.column("n_shingles").to_numpy(),
        "keys": keys,
        "earlier": int((keys[0] == key).argmax()),
        "brief": np.frombuffer(b"".join(rows.column("brief").to_pylist()), dtype="<u2").reshape(rows.num_rows, -1),
    }


def _other_links(
    bands: DataFrame, labels: DataFrame, wanted: DataFrame, texts: DataFrame, percent: int, least: int
) -> DataFrame:
    """Links between classes of a band that no chain of links connects so far.

    ``bands`` is without the smallest class of each, with which all others were compared.
    A large band is cut into blocks, and each two blocks meet in a group of their own.
    Two classes are to be compared when they belong to different components, agree in
    ``least`` places, are of similar size, and meet in no earlier band. Groups meet
    twice: first without the sets, which leaves the classes that have a partner; then
    these with their texts, of which full sets are made. Links found unite components at once, so of the many
    links within a group only those are compared and given out that still connect
    something.
    """
    shown = labels.select(F.col("node").alias("class"), "label")
    marked = bands.join(shown, "class", "left").withColumn("label", F.coalesce("label", "class"))
    marked = marked.join(wanted.select("class", "n_shingles"), "class")
    mixed = marked.groupBy("key").agg(
        F.sum("n_shingles").alias("size"), F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high")
    )
    blocks = F.ceil(F.greatest(F.col("size") / SHINGLES, F.col("n") / BLOCK)).cast("int")
    mixed = stage(mixed.filter(F.col("low") != F.col("high")).select("key", blocks.alias("blocks")), "mixed_bands")
    inside = marked.join(mixed, "key").join(wanted.select("class", "bands", "brief"), "class")
    meets = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.struct(F.least("own", other).alias("one"), F.greatest("own", other).alias("two")),
    )
    on, kept = ["key", "one", "two"], ["class", "label", "n_shingles", "bands", "brief", "own"]
    first = (
        inside.withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
        .select("key", *kept, F.explode(meets).alias("meet"))
        .select("key", "meet.one", "meet.two", *kept)
        .repartition(*on)
        .sortWithinPartitions(*on)
    )

    def with_partner(batches):
        for (key, one, two), rows in sorted_groups(batches, on):
            group = _arrays(key, one, two, rows)
            has = np.zeros(rows.num_rows, dtype=bool)
            for i in group["left"]:
                partners = _partners(i, group, percent, least)
                has[partners] = True
                has[i] |= len(partners) > 0
            if has.any():
                yield from rows.filter(pa.array(has)).combine_chunks().to_batches()

    schema = "key long, one int, two int, class binary, label binary, n_shingles long, bands array<long>, brief binary, own int"
    chosen = stage(first.mapInArrow(released(with_partner), schema), "with_partner")
    packed = _packed(wanted.join(chosen.select("class"), "class", "left_semi"), texts)
    dealt = chosen.join(packed, "class").select(*on, *kept, "packed", "raw").repartition(*on).sortWithinPartitions(*on)

    def compare(batches):
        for (key, one, two), rows in sorted_groups(batches, on):
            group = _arrays(key, one, two, rows)
            names, label = rows.column("class").to_pylist(), rows.column("label").to_pylist()
            sets = list(_unpacked(rows))
            size = group["size"]
            parent: dict[bytes, bytes] = {}

            def root(x):
                while (up := parent.get(x, x)) != x:
                    x = up
                return x

            links = []
            for i in group["left"]:
                j = _partners(i, group, percent, least)
                while len(j):
                    now, j = j[:64], j[64:]
                    now = [x for x in now if root(label[x]) != root(label[i])]
                    if not now:
                        continue
                    every = np.concatenate([sets[x] for x in now])
                    at = np.searchsorted(sets[i], every)
                    at[at == size[i]] = 0
                    shared = np.add.reduceat((sets[i][at] == every).astype(np.int64), np.concatenate(([0], np.cumsum(size[now])[:-1])))
                    for x in np.array(now)[100 * shared >= percent * (size[now] + size[i] - shared)]:
                        a, b = root(label[x]), root(label[i])
                        if a != b:
                            parent[max(a, b)] = min(a, b)
                            links.append((max(names[x], names[i]), min(names[x], names[i])))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], ["a", "b"])

    return dealt.mapInArrow(released(compare), "a binary, b binary")


def _few(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The ``rows`` whose ``column`` is in ``keys``, and maybe a few others."""
    blocks = blooms.blocks_for(keys.count())
    mark = F.xxhash64(column)
    return blooms.marked(rows, mark, blooms.bloom_of(keys, mark, blocks), blocks).filter("maybe").drop("maybe")


def _one_each(some: DataFrame, classes: DataFrame) -> DataFrame:
    """``class, doc_id, text_key, n_shingles, bands, brief`` of one row of each class.

    Only rows of classes that may have several are shuffled.
    """
    columns = ["doc_id", "text_key", "n_shingles", "bands", "brief"]
    several = classes.filter("n > 1").select("class")
    blocks, mark = blooms.blocks_for(several.count()), F.xxhash64("class")
    rows = blooms.marked(some.select("class", *columns), mark, blooms.bloom_of(several, mark, blocks), blocks)
    first = rows.filter("maybe").groupBy("class").agg(F.min(F.struct(*columns)).alias("row"))
    first = stage(first.select("class", "row.*"), "several")
    return rows.filter("NOT maybe").select("class", *columns).unionByName(first)


def _shared_bands(one_each: DataFrame) -> DataFrame:
    """Staged ``key, class, pivot`` of bands with several classes; the pivot is the smallest.

    Bands are first counted without their classes; few others are shuffled then.
    """
    spread = one_each.select("class", F.explode("bands").alias("key"))
    keys = stage(spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "shared_keys")
    spread = _few(spread, "key", keys)
    pivots = spread.groupBy("key").agg(F.min("class").alias("pivot"), F.count(F.lit(1)).alias("n"))
    return stage(spread.join(pivots.filter("n > 1").select("key", "pivot"), "key"), "shared_bands")


def _named(signed: DataFrame, classes: DataFrame, named: DataFrame) -> DataFrame:
    """Rows with the component of their class; the rows of a large class are not shuffled by it, or salted."""
    every = classes.select("class", "low", "n").join(named, "class", "left")
    every = every.select("class", F.coalesce("component_id", "low").alias("component_id"), "n")
    hot = stage(every.filter(F.col("n") > COPIES).drop("n"), "large_classes")
    rest = every.filter(F.col("n") <= COPIES).drop("n")
    if hot.isEmpty():
        return signed.join(rest, "class", "left")
    copies = join_small(signed, hot, "class", salt_by="doc_id")
    gone = hot.select("class")
    others = signed.join(F.broadcast(gone) if fits_broadcast(gone) else gone, "class", "left_anti")
    return copies.unionByName(others.join(rest, "class", "left"))


def near_duplicates(
    documents: DataFrame,
    percent: int = 85,
    id_column: str = "doc_id",
    text_column: str = "text",
    bands: int = BANDS,
    rows: int = ROWS,
    agreement: int = AGREEMENT,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``documents``, and the ``carry`` columns.

    Documents are linked when ``100 * intersection >= percent * union`` of their sets.
    ``component_id`` is the least id that links lead to. A document without words (or
    with a null text) is linked with nothing and is its own component. Rows that
    repeat have one id and one set, hence one component, and all are kept or none is.
    A null id is never the least of several; alone it leaves ``component_id`` null and
    the row kept. An empty table gives no rows. Other columns are left out.
    """
    signed = stage(_signed(documents, id_column, text_column, bands, rows, carry), "signed")
    some = signed.filter(F.col("class").isNotNull())
    classes = stage(some.groupBy("class").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "classes")
    one_each = _one_each(some, classes)
    shared = _shared_bands(one_each)
    names = stage(shared.select("class").distinct(), "names")
    wanted = stage(_few(one_each, "class", names).join(names, "class"), "wanted")
    others = shared.filter(F.col("class") != F.col("pivot"))
    stars = others.select(F.col("class").alias("a"), F.col("pivot").alias("b")).distinct()
    text = F.col(f"`{text_column}`")
    texts = documents.select(F.col(f"`{id_column}`").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    links = _linked(stage(_agreeing(stars, wanted, percent, agreement), "agreeing"), wanted, texts, percent)
    labels = components(links)
    extra = stage(_other_links(others.select("key", "class"), labels, wanted, texts, percent, agreement), "other_links")
    if not extra.isEmpty():
        labels = components(links.unionByName(extra))
    labels = stage(labels, "labels")
    low = labels.join(classes.select(F.col("class").alias("node"), "low"), "node").groupBy("label").agg(F.min("low").alias("component_id"))
    named = labels.join(low, "label").select(F.col("node").alias("class"), "component_id")
    found = _named(signed.drop("text_key", "bands", "brief"), classes, named)
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.coalesce(F.col("doc_id") == component, component.isNull())
    return found.select(
        "doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), *(F.col(f"carried {c}").alias(c) for c in carry)
    )
