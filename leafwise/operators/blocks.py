"""Postings in blocks, and search that leaves out what cannot reach a page.

Documents are cut into shards as they are read, so building blocks shuffles nothing. A
block holds the postings of a term of a field in one shard, by ordinal of the document;
lengths of fields are kept once for each document.

A search brings the blocks of its words and the queries of a batch together by shard.
There a word's best score in a document is found once for all queries; each query has,
for every run of documents, an upper bound from the best scores of its words in the run.
Runs are scored from the highest bound on, until the bound falls below the score of the
last row on the query's page so far. Hits are counted from bit sets of the documents of
each word, without scores. A task gives out the rows of a page and a count for each
query, so no table of queries and documents is ever made.
"""

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwise.operators.scoring import term_bucket, with_factor
from leafwise.plans.groups import giving_back, ranges, runs_of
from leafwise.plans.joins import join_frequent, join_small
from leafwise.plans.staging import stage
from leafwise.schema import BM25_B, BM25_K1, FIELDS, SCORE_DIGITS

# Task functions go along with the job, so that executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Documents of a shard, and postings after which a shard ends earlier.
SHARD_DOCUMENTS, SHARD_POSTINGS = 2048, 1 << 19
#: Documents of a run, which has a bound of its own.
RUN = 256
#: Queries, and terms of queries, that meet a shard at a time.
QUERIES, QUERY_TERMS = 256, 1 << 20
#: Scores of postings for words that a task makes at a time.
POSTINGS_AT_ONCE = 1 << 18
#: Runs scored before the first look at the bounds.
FIRST_RUNS = 4
#: Bytes from which a parcel of blocks is compressed.
PARCEL = 512
BLOCKS = "shard long, ids array<string>, lengths array<int>, field string, term string, ords array<int>, tfs array<int>"


def _cut(parts: list[pa.RecordBatch], shard: int):
    """The documents of a shard in order of id, then its blocks."""
    table = pa.Table.from_batches(parts).combine_chunks()
    table = table.take(pc.sort_indices(table, [("doc_id", "ascending")])).combine_chunks()
    column = lambda name: table.column(name).combine_chunks()
    none = lambda n, kind: pa.nulls(n, kind)
    ints = pa.list_(pa.int32())
    names = ["shard", "ids", "lengths", "field", "term", "ords", "tfs"]
    ids = pa.array([column("doc_id").to_pylist()], pa.list_(pa.string()))
    text = none(1, pa.string())
    fields = column("fields")
    document = np.repeat(np.arange(table.num_rows), fields.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    entries = fields.flatten()
    field = np.array([FIELDS.index(f) for f in entries.field("field").to_pylist()], dtype=np.int64)
    lengths = np.zeros(len(FIELDS) * table.num_rows, dtype=np.int32)
    lengths[field * table.num_rows + document] = entries.field("dl").to_numpy(zero_copy_only=False)
    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), ids, pa.array([lengths], ints), text, text, *([none(1, ints)] * 2)], names)
    terms = entries.field("terms")
    entry = np.repeat(np.arange(len(entries)), terms.value_lengths().to_numpy(zero_copy_only=False))
    found = terms.flatten()
    if not len(found):
        return
    words = found.field("value").dictionary_encode()
    code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    tf = found.field("n").to_numpy(zero_copy_only=False)
    key = field[entry] * len(words.dictionary) + code
    order = np.lexsort((document[entry], key))
    key, entry, tf = key[order], entry[order], tf[order]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    ends = np.concatenate((starts[1:], [len(key)]))
    for a in range(0, len(starts), 1 << 15):
        some, until = starts[a : a + (1 << 15)], ends[a : a + (1 << 15)]
        inside = slice(int(some[0]), int(until[-1]))
        edges = pa.array(np.concatenate((some, until[-1:])) - some[0], pa.int32())
        lists = [pa.ListArray.from_arrays(edges, pa.array(v[inside].astype(np.int32))) for v in (document[entry], tf)]
        field_no, word = np.divmod(key[some], len(words.dictionary))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(some), shard)),
                none(len(some), pa.list_(pa.string())),
                none(len(some), ints),
                pa.array(np.array(FIELDS, dtype=object)[field_no], pa.string()),
                words.dictionary.take(pa.array(word)),
                *lists,
            ],
            names,
        )


def block_postings(terms: DataFrame, shard_documents: int = SHARD_DOCUMENTS) -> DataFrame:
    """Blocks of ``document_terms``; narrow, no shuffle. To be staged, as shards are numbered by task.

    A row with ``ids`` lists the documents of a shard by ordinal, and the ``lengths`` of
    their fields, field by field; each other row is the block of a term of a field:
    ordinals of documents and counts.
    """

    def run(batches):
        shard, held, rows, postings = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch in batches:
            sizes = _postings(batch)
            start = 0
            while start < batch.num_rows:
                room = np.cumsum(sizes[start:]) + postings
                n = max(1, min(shard_documents - rows, int(np.searchsorted(room, SHARD_POSTINGS)) + 1, batch.num_rows - start))
                held.append(batch.slice(start, n))
                rows, postings, start = rows + n, int(room[n - 1]), start + n
                if rows >= shard_documents or postings >= SHARD_POSTINGS:
                    yield from _cut(held, shard)
                    shard, held, rows, postings = shard + 1, [], 0, 0
        if held:
            yield from _cut(held, shard)

    return terms.select("doc_id", "fields").mapInArrow(lambda batches: giving_back(run(batches)), BLOCKS)


def _postings(batch: pa.RecordBatch) -> np.ndarray:
    """Number of postings of each document."""
    fields = batch.column("fields")
    counts = fields.flatten().field("terms").value_lengths().to_numpy(zero_copy_only=False)
    sums = np.concatenate(([0], np.cumsum(counts)))
    ends = np.cumsum(fields.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return np.diff(np.concatenate(([0], sums[ends])))


def places_of(blocks: DataFrame) -> DataFrame:
    """``(shard, ord, doc_id)`` of every document, and the lengths of its fields (``dls``)."""
    listed = blocks.filter(F.col("ids").isNotNull())
    each = listed.select("shard", "lengths", F.size("ids").alias("size"), F.posexplode("ids").alias("ord", "doc_id"))
    return each.select("shard", "ord", "doc_id", F.array(*[F.get("lengths", F.col("ord") + i * F.col("size")) for i in range(len(FIELDS))]).alias("dls"))


def postings_from(blocks: DataFrame, places: DataFrame) -> DataFrame:
    """``(field, term, doc_id, tf, dl)``: the postings of blocks, of documents that have a place."""
    each = blocks.filter(F.col("ids").isNull()).select(
        "shard", "field", "term", F.explode(F.arrays_zip("ords", "tfs")).alias("p")
    )
    each = each.select("shard", "field", "term", F.col("p.ords").alias("ord"), F.col("p.tfs").cast("bigint").alias("tf"))
    length = F.get("dls", F.array_position(F.array(*map(F.lit, FIELDS)), F.col("field")).cast("int") - 1)
    return each.join(places, ["shard", "ord"]).select("field", "term", "doc_id", "tf", length.cast("bigint").alias("dl"))


def block_stats(blocks: DataFrame) -> DataFrame:
    """``term_stats`` of the documents in blocks: ``(field, term, df)``."""
    own = blocks.filter(F.col("ids").isNull()).select("field", "term", F.size("ords").alias("n"))
    return own.groupBy("field", "term").agg(F.sum("n").alias("df"))


def block_field_stats(blocks: DataFrame) -> DataFrame:
    """``(field, n_docs, tokens)`` of the documents in blocks: those with a token in the field, and their tokens."""
    shards = blocks.filter(F.col("ids").isNotNull())
    size = F.size("ids")
    own = F.array(*[F.struct(F.lit(f).alias("field"), F.slice("lengths", 1 + i * size, size).alias("l")) for i, f in enumerate(FIELDS)])
    each = shards.filter(size > 0).select(F.explode(own).alias("f")).select("f.field", F.explode("f.l").alias("dl")).filter("dl > 0")
    return each.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("dl").alias("tokens"))


def _parcels(batches):
    """Task function: blocks for a group of queries in one shard, in one row; see ``_opened``."""
    for batch in batches:
        queries, shards = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("queries", "shard"))
        order = np.lexsort((shards, queries))
        batch = batch.take(pa.array(order))
        queries, shards = queries[order], shards[order]
        begins = np.flatnonzero(np.concatenate((np.ones(min(1, len(order)), dtype=bool), (np.diff(queries) != 0) | (np.diff(shards) != 0))))
        names = batch.column("field").dictionary_encode()
        field = np.array([FIELDS.index(f) for f in names.dictionary.to_pylist()], dtype=np.int32)[names.indices.to_numpy()] if len(order) else np.zeros(0, dtype=np.int32)
        mean = batch.column("avgdl").to_numpy(zero_copy_only=False)
        lists = {c: batch.column(c) for c in ("term_ids", "factors", "ords", "tfs")}
        sizes = {c: lists[c].value_lengths().to_numpy(zero_copy_only=False).astype(np.int32) for c in ("term_ids", "ords")}
        edges = {c: np.concatenate(([0], np.cumsum(n, dtype=np.int64))) for c, n in sizes.items()}
        flat = {c: v.flatten().to_numpy(zero_copy_only=False) for c, v in lists.items()}
        parcels = []
        for a, b in zip(begins, np.append(begins[1:], len(order))):
            words, postings = (slice(edges[c][a], edges[c][b]) for c in ("term_ids", "ords"))
            counts = np.array([b - a, words.stop - words.start, postings.stop - postings.start], dtype=np.int64)
            own = [counts, flat["term_ids"][words], flat["factors"][words], mean[a:b], field[a:b], sizes["term_ids"][a:b], sizes["ords"][a:b], flat["ords"][postings], flat["tfs"][postings]]
            data = b"".join(v.tobytes() for v in own)
            short = pa.compress(data, codec="zstd", asbytes=True) if len(data) >= PARCEL else data
            parcels.append(np.int64(len(data)).tobytes() + short)
        yield pa.RecordBatch.from_arrays([pa.array(queries[begins]), pa.array(shards[begins]), pa.array(parcels, pa.binary())], ["queries", "shard", "parcel"])


def _opened(parcels) -> dict:
    """The blocks of some parcels: ``mean``, ``field``, ``words`` and ``postings`` (counts) by block; ``term``, ``factor``; ``ord``, ``tf``."""
    kinds = [("term", np.int64, 1), ("factor", np.float64, 1), ("mean", np.float64, 0), ("field", np.int32, 0), ("words", np.int32, 0), ("postings", np.int32, 0), ("ord", np.int32, 2), ("tf", np.int32, 2)]
    parts: dict = {name: [np.zeros(0, dtype=kind)] for name, kind, _ in kinds}
    for parcel in parcels:
        n, data = int(np.frombuffer(parcel, np.int64, 1)[0]), parcel[8:]
        data = pa.decompress(data, decompressed_size=n, codec="zstd", asbytes=True) if n >= PARCEL else data
        counts, at = np.frombuffer(data, np.int64, 3), 24
        for name, kind, of in kinds:
            parts[name].append(np.frombuffer(data, kind, int(counts[of]), at))
            at += parts[name][-1].nbytes
    return {name: np.concatenate(v) for name, v in parts.items()}


class _Shard:
    """The words of a batch of queries in one shard."""

    def __init__(self, parcels, lengths: np.ndarray, dead: np.ndarray, size: int):
        rows = _opened(parcels)
        sizes = rows["postings"].astype(np.int64)
        edges = np.concatenate(([0], np.cumsum(sizes)))
        field = rows["field"].astype(np.int64)
        mean, place, tf = np.repeat(rows["mean"], sizes), rows["ord"], rows["tf"]
        norm = tf + BM25_K1 * (1 - BM25_B + BM25_B * lengths[np.repeat(field, sizes) * size + place] / mean)
        alive = np.ones(size, dtype=bool)
        alive[dead] = False
        block = np.repeat(np.arange(len(field)), rows["words"])
        self.terms, term = np.unique(rows["term"], return_inverse=True)
        word, factor = field[block] * len(self.terms) + term, rows["factor"]
        order = np.argsort(word, kind="stable")
        word, block, factor = word[order], block[order], factor[order]
        self.size, self.runs = size, -(-size // RUN) or 1
        # a block stands for many words, so its postings are taken a few words at a time
        begins = np.flatnonzero(np.concatenate((np.ones(min(1, len(word)), dtype=bool), np.diff(word) != 0)))
        ends = np.append(begins[1:], len(word))
        total = np.concatenate(([0], np.cumsum(sizes[block])))
        parts, at = [self._part(*[np.zeros(0, dtype=t) for t in (np.int64, np.int64, float)])], 0
        while at < len(begins):
            until = max(at + 1, int(np.searchsorted(total[ends], total[begins[at]] + POSTINGS_AT_ONCE, side="right")))
            some = slice(begins[at], ends[until - 1])
            posting, owner = ranges(edges[block[some]], edges[block[some] + 1])
            keep = alive[place[posting]]
            posting, owner = posting[keep], owner[keep]
            scores = factor[some][owner] * tf[posting] * (BM25_K1 + 1) / norm[posting]
            parts.append(self._part(word[some][owner], place[posting], scores))
            at = until
        self.words, counts, self.bound, self.bits, self.place, self.score = (np.concatenate(c) for c in zip(*parts))
        self.begins = np.concatenate(([0], np.cumsum(counts.ravel())))

    def _part(self, word, place, score):
        """Of some words: their numbers, documents and bounds by run, bit sets, places and best scores."""
        order = np.lexsort((place, word))
        word, place, score = word[order], place[order], score[order]
        first = lambda *keys: np.flatnonzero(np.concatenate((np.ones(min(1, len(word)), dtype=bool), np.any([np.diff(k) != 0 for k in keys], axis=0))))
        starts = first(word, place)
        score = np.maximum.reduceat(score, starts) if len(starts) else score  # of the best expansion
        word, place = word[starts], place[starts]
        words, number = np.unique(word, return_inverse=True)
        counts = np.bincount(number * self.runs + place // RUN, minlength=len(words) * self.runs)
        bound, full = np.zeros(len(words) * self.runs), np.flatnonzero(counts)
        if len(full):
            bound[full] = np.maximum.reduceat(score, (np.cumsum(counts) - counts)[full])
        width = -(-self.size // 8)
        bits, starts = np.zeros(len(words) * width, dtype=np.uint8), first(word, place >> 3)
        if len(starts):
            bits[number[starts] * width + (place[starts] >> 3)] = np.bitwise_or.reduceat((1 << (place & 7)).astype(np.uint8), starts)
        shaped = lambda a: a.reshape(len(words), -1 if len(words) else (width if a is bits else self.runs))
        return words, shaped(counts), shaped(bound), shaped(bits), place.astype(np.int32), score

    def number(self, field: np.ndarray, term_id: np.ndarray) -> np.ndarray:
        """The number of each word here, or -1."""
        if not len(self.words):
            return np.full(len(field), -1)
        term = np.minimum(np.searchsorted(self.terms, term_id), len(self.terms) - 1)
        word = field * len(self.terms) + term
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        return np.where((self.terms[term] == term_id) & (self.words[at] == word), at, -1)

    def hits(self, words: np.ndarray) -> np.ndarray:
        """Ordinals of the documents that have any of the words."""
        if not len(words):
            return np.zeros(0, dtype=np.int64)
        return np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(self.bits[words], axis=0), bitorder="little"))

    def bounds(self, words, fields, mult) -> np.ndarray:
        """For each run the most that a document in it can have."""
        best = np.zeros(self.runs)
        for field in np.unique(fields):
            own = fields == field
            best = np.maximum(best, mult[own] @ self.bound[words[own]])
        return best

    def scores(self, words, fields, mult, runs) -> np.ndarray:
        """Scores of all documents of these runs, by ordinal; 0 without a hit or in another run."""
        cells = (words[:, None] * self.runs + runs[None, :]).ravel()
        at, owner = ranges(self.begins[cells], self.begins[cells + 1])
        row = owner // len(runs)
        sums = np.bincount(fields[row] * self.size + self.place[at], weights=mult[row] * self.score[at], minlength=len(FIELDS) * self.size)
        return sums.reshape(len(FIELDS), self.size).max(axis=0)


def _page_rows(shard: _Shard, words, fields, mult, near, k: int, best: np.ndarray, skip: bool):
    """``(ords, scores, scored runs)`` of a query's rows that may be on its page.

    ``near``: scores of nearest neighbours by ordinal; ``best``: rounded scores of the
    rows that the task has given out for the query so far, the best ``k``.
    """
    bounds = shard.bounds(words, fields, mult)
    extra = np.zeros(shard.size)
    extra[list(near)] = list(near.values())
    nearest = np.zeros(shard.runs)
    np.maximum.at(nearest, np.arange(shard.size) // RUN, extra)
    bounds = bounds + nearest
    order = np.argsort(-bounds, kind="stable")
    order = order[bounds[order] > 0]
    least = best.min() if len(best) >= k else 0.0
    ords, found, done = np.zeros(0, dtype=np.int64), np.zeros(0), 0
    step = FIRST_RUNS
    while done < len(order):
        if skip and bounds[order[done]] < least - 2 * 10.0**-SCORE_DIGITS:
            break
        runs = order[done : done + step] if skip else order[done:]
        if skip:
            runs = runs[bounds[runs] >= least - 2 * 10.0**-SCORE_DIGITS]
        done, step = done + len(runs), 2 * step
        scores = shard.scores(words, fields, mult, runs) if len(words) else np.zeros(shard.size)
        inside = np.zeros(shard.runs, dtype=bool)
        inside[runs] = True
        scores = scores + np.where(inside[np.arange(shard.size) // RUN], extra, 0)
        at = np.flatnonzero(scores > 0)
        ords, found = np.concatenate((ords, at)), np.concatenate((found, scores[at]))
        rounded = np.round(found, SCORE_DIGITS)
        keep = np.lexsort((ords, -rounded))[:k]
        ords, found = ords[keep], found[keep]
        all_best = np.concatenate((best, rounded[keep]))
        least = np.partition(all_best, len(all_best) - k)[len(all_best) - k] if len(all_best) >= k else 0.0
    stays = np.round(found, SCORE_DIGITS) >= least
    return ords[stays], found[stays], done


def _search(batches, kind, skip):
    """Task function: rows of pages and counts of the queries of each group."""
    held, held_queries = {}, None
    for (queries, shard_no), group in runs_of(batches, ["queries", "shard"]):
        if queries != held_queries:
            held, held_queries = {}, queries  # best scores of each query so far
        role = group.column("role").to_numpy()
        part = lambda r, group=group, role=role: group.filter(pa.array(role == r))
        packed = part(0)
        if not packed.num_rows:
            continue
        size = packed.column("size")[0].as_py()
        dead = part(3).column("ord").to_numpy()
        lengths = packed.column("lengths").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        shard = _Shard(part(1).column("parcel").to_pylist(), lengths, dead, size)
        near: dict = {}
        knn = part(2)
        for q, o, s in zip(*(knn.column(c).to_pylist() for c in ("query_id", "ord", "score"))):
            near.setdefault(q, {})[o] = s
        asked = packed.column("asked").combine_chunks().flatten()
        ids, depth = asked.field("query_id").to_pylist(), asked.field("depth").to_pylist()
        lists = asked.field("terms")
        ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        terms = lists.flatten()
        fields = np.array([FIELDS.index(f) for f in terms.field("field").to_pylist()], dtype=np.int64)
        mult = terms.field("mult").to_numpy(zero_copy_only=False).astype(float)
        words = shard.number(fields, terms.field("term_id").to_numpy(zero_copy_only=False))
        rows, counts = [], []
        for i, q in enumerate(ids):
            own = slice(ends[i - 1] if i else 0, ends[i])
            known = words[own] >= 0
            w, f, m = words[own][known], fields[own][known], mult[own][known]
            close = near.get(q, {})
            hits = shard.hits(w)
            n = len(np.union1d(hits, list(close))) if close else len(hits)
            if not n:
                continue
            best = held.get(q, np.zeros(0))
            scored = 0
            if depth[i] > 0:
                ords, scores, scored = _page_rows(shard, w, f, m, close, depth[i], best, skip)
                rows += [(q, o, s) for o, s in zip(ords.tolist(), scores.tolist())]
                every = np.sort(np.concatenate((best, np.round(scores, SCORE_DIGITS))))
                held[q] = every[-depth[i] :]
            counts.append((q, n, scored, shard.runs))
        every = len(rows) + len(counts)
        pad = lambda values, more, kind: pa.array([*values, *([None] * more)], kind)
        after = lambda more, values, kind: pa.array([*([None] * more), *values], kind)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows] + [c[0] for c in counts], kind),
                pa.array([shard_no] * every, pa.int64()),
                pad([r[1] for r in rows], len(counts), pa.int32()),
                pad([r[2] for r in rows], len(counts), pa.float64()),
                *(after(len(rows), [c[x] for c in counts], pa.int64()) for x in (1, 2, 3)),
            ],
            ["query_id", "shard", "ord", "score", "hits", "scored_runs", "runs"],
        )


def best_rows(
    terms: DataFrame,
    expanded: DataFrame,
    depths: DataFrame,
    blocks: DataFrame,
    places: DataFrame,
    field_stats: DataFrame,
    near: DataFrame | None = None,
    dead: DataFrame | None = None,
    buckets: int | None = None,
    skip: bool = True,
) -> DataFrame:
    """``(query_id, shard, ord, score, hits, scored_runs, runs)``, staged: what each task found.

    Rows with an ordinal are candidates for the page of a query: all that are among
    the first ``depth`` rows of any shard, but for those that a task knew to be below
    the page. Rows without one count the hits of a query in a shard. ``depths`` has
    ``(query_id, depth)`` for each query, ``near`` its nearest neighbours
    ``(query_id, doc_id, score)``, whose scores are added. Documents in ``dead``
    (``shard, ord``) are left out. ``skip`` off scores every run; the result is the same.
    """
    kind = depths.schema["query_id"].dataType.simpleString()
    numbers = expanded.select("term", "term_id").distinct()
    asked = join_small(terms, numbers, "term", salt_by="query_id").select("query_id", "field", "term_id", "mult")
    each = asked.groupBy("query_id").agg(F.collect_list(F.struct("field", "term_id", "mult")).alias("terms"))
    each = stage(depths.select("query_id", F.col("depth").cast("int").alias("depth")).join(each, "query_id", "left"), "asked")
    n, size = each.agg(F.count(F.lit(1)), F.sum(F.size(F.coalesce("terms", F.array().cast(each.schema["terms"].dataType))))).first()
    groups = max(1, -(-n // QUERIES), -(-(size or 0) // QUERY_TERMS))
    group = F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("queries")
    packed = each.groupBy(group).agg(F.collect_list(F.struct("query_id", "depth", "terms")).alias("asked"))
    wanted = each.select(group, F.explode("terms").alias("t")).select("queries", "t.field", "t.term_id").distinct()
    scored = with_factor(expanded, field_stats).select("field", "term_id", F.col("expansion").alias("term"), "factor", "avgdl", "df")
    # a block goes to a group of queries once, with all the words it stands for
    wanted = join_small(wanted, scored, ["field", "term_id"], salt_by="queries").groupBy("queries", "field", "term", "avgdl")
    wanted = wanted.agg(F.collect_list(F.struct("term_id", "factor")).alias("w"), F.max("df").alias("df"))
    wanted = wanted.select("queries", "field", "term", "avgdl", "df", F.col("w.term_id").alias("term_ids"), F.col("w.factor").alias("factors"))
    on = ["field", "term"]
    if buckets:
        wanted, on = wanted.withColumn("bucket", term_bucket(F.col("term"), buckets)), [*on, "bucket"]
    wanted = stage(wanted, "wanted_blocks", compression="zstd")
    met = join_frequent(blocks.filter(F.col("ids").isNull()).drop("ids", "lengths"), wanted, on, "df")
    met = met.select("queries", "shard", "field", "avgdl", "term_ids", "factors", "ords", "tfs")
    met = met.mapInArrow(lambda batches: giving_back(_parcels(batches)), "queries int, shard long, parcel binary")
    shards = blocks.filter(F.col("ids").isNotNull()).select("shard", F.size("ids").alias("size"), "lengths")
    pairs = shards.withColumn("queries", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    columns = {
        "queries": "int", "shard": "long", "role": "int", "size": "int", "lengths": "array<int>", "asked": packed.schema["asked"].dataType.simpleString(), "parcel": "binary", "query_id": kind, "ord": "int", "score": "double",
    }

    def shaped(df, role):
        known = set(df.columns)
        return df.select(*(F.lit(role).alias(c) if c == "role" else (F.col(c) if c in known else F.lit(None)).cast(t).alias(c) for c, t in columns.items()))

    both = shaped(join_small(pairs, packed, "queries", salt_by="shard"), 0).unionByName(shaped(met, 1))
    if near is not None:
        found = join_small(places.select("shard", "ord", "doc_id"), near, "doc_id", salt_by="ord")
        both = both.unionByName(shaped(found.withColumn("queries", group), 2))
    if dead is not None:
        both = both.unionByName(shaped(dead.withColumn("queries", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))), 3))
    dealt = both.repartition("queries", "shard").sortWithinPartitions("queries", "shard")
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    schema = f"query_id {kind}, shard long, ord int, score double, hits long, scored_runs long, runs long"
    return stage(dealt.mapInArrow(lambda batches: giving_back(_search(batches, arrow, skip)), schema), "page_rows")


def page_scores(best: DataFrame, places: DataFrame) -> DataFrame:
    """``(query_id, doc_id, score)`` of the rows found."""
    rows = best.filter(F.col("ord").isNotNull()).select("query_id", "shard", "ord", "score")
    return join_small(places.select("shard", "ord", "doc_id"), rows, ["shard", "ord"]).select("query_id", "doc_id", "score")


def hit_counts(best: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, total)``; 0 for a query without hits."""
    counts = best.filter(F.col("ord").isNull()).groupBy("query_id").agg(F.sum("hits").alias("total"))
    return queries.select("query_id").join(counts, "query_id", "left").select("query_id", F.coalesce("total", F.lit(0)).cast("bigint").alias("total"))
