"""Secret scans with corpus-wide ownership frequency.

Spans come from regular expressions. Splitting a text by an expression gives what
lies between its matches, so running sums over the lengths of both give their places.
Beside the base kinds there are candidates: long mixed tokens that look like
credentials. The hash of each value, of base spans and of candidates alike, is counted
over the corpus by distinct owners and repositories. A value that many owners hold is
an example that was copied about, and so is one that stands in many repositories of
one owner; one of a single owner and few repositories looks live. Live candidates
become spans of their own; base spans stay and are told by their class. Hashes are
shuffled, and the rows of those documents only that have a span.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwise.plans.joins import join_small
from leafwise.plans.staging import stage

#: Fixed expressions of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Candidates of the method: long tokens with a digit and letters of both cases.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "live")
LEAST_ASSIGNED = 6
#: A value held by more owners than this is a copied example.
MAX_OWNERS = 1
#: So is one in more repositories than this, whoever owns them.
MAX_REPOSITORIES = 10


def running_sums(values: Column, size: Column) -> Column:
    """Sums of all values before each: as many zips as the logarithm of the length."""
    shifted = lambda a, by: F.concat(F.array_repeat(F.lit(0), F.least(by, size)), F.slice(a, 1, F.greatest(size - by, F.lit(0))))
    powers = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(size + 1)).cast("int")), lambda k: F.expr("1") * F.pow(F.lit(2), k).cast("int"))
    add = lambda a, by: F.zip_with(a, shifted(a, by), lambda x, y: x + y)
    return F.aggregate(powers, shifted(values, F.lit(1)), add)


def spans(text: Column, pattern: str, kind: int, least: int = 0) -> Column:
    """``array<struct<start, kind, end, value>>`` of the matches, in code points, end exclusive.

    With ``least`` the second group must have so many characters, and is the value; a
    match that fails still uses up its text.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    size = F.size(found)
    lengths = F.zip_with(F.slice(between, 1, size), found, lambda b, m: F.length(b) + F.length(m))
    starts = F.zip_with(running_sums(lengths, size), F.slice(between, 1, size), lambda s, b: s + F.length(b))
    made = F.zip_with(
        starts,
        found,
        lambda s, m: F.struct(s.alias("start"), F.lit(kind).alias("kind"), (s + F.length(m)).alias("end"), m.alias("value")),
    )
    if least:
        groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
        made = F.transform(
            F.filter(F.arrays_zip(made.alias("span"), groups.alias("own")), lambda x: F.length(x["own"]) >= least),
            lambda x: F.struct(x["span"]["start"].alias("start"), x["span"]["kind"].alias("kind"), x["span"]["end"].alias("end"), x["own"].alias("value")),
        )
    none = F.filter(F.array(F.struct(F.lit(0).alias("start"), F.lit(kind).alias("kind"), F.lit(0).alias("end"), F.lit("").alias("value"))), lambda x: F.lit(False))
    return F.when(text.rlike(pattern), made).otherwise(none)


def _joined(found: Column, classes: bool = False) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    told = lambda s: [F.when(s["live"], "live").otherwise("copied")] * classes
    shown = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"], *told(s))
    return F.array_join(F.transform(found, shown), ",")


def scan_secrets(
    documents: DataFrame,
    max_owners: int = MAX_OWNERS,
    id_column: str = "doc_id",
    text_column: str = "text",
    owner_column: str = "source",
    carry: tuple[str, ...] = (),
    max_repositories: int = MAX_REPOSITORIES,
) -> DataFrame:
    """One row per document: the base spans, and those of candidates that look live.

    ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied,
    base_classes, n_base_live, n_base_copied, found`` and the columns named in
    ``carry``. ``found`` is the sorted array of all spans; ``n_live`` and ``n_copied``
    count candidates, the latter those whose value more than ``max_owners`` owners
    hold or more than ``max_repositories`` repositories. ``base_classes`` lists the base spans with ``live`` or ``copied`` behind
    each, by the same rule; they are in ``spans`` and ``found`` either way. The value
    of an assignment is what is assigned, so the same key counts as one value in
    whatever way it was found. A candidate that overlaps a base span is not listed
    again. A repository is a document id of an owner; a null id or owner counts as one
    repository or owner of its own kind. A null text is empty and has no spans; rows that repeat
    are all returned; an empty table gives no rows.
    """
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    base = F.concat(spans(F.col("t"), ASSIGN, 0, LEAST_ASSIGNED), spans(F.col("t"), ACCESS, 1), spans(F.col("t"), HEX, 2))
    chosen = documents.select(
        F.col(f"`{id_column}`").alias("doc_id"),
        F.coalesce(F.col(f"`{owner_column}`"), F.lit("")).alias("owner"),
        text.alias("t"),
        *(F.col(f"`{c}`").alias(f"carried {c}") for c in carry),
    )
    more = F.filter(
        F.col("more"), lambda c: ~F.exists(F.col("base"), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    )
    hashed = F.transform(
        F.concat("base", more), lambda s: F.struct(s["start"], s["kind"], s["end"], F.sha2(s["value"], 256).alias("hash"))
    )
    scanned = (
        chosen.withColumn("base", base)
        .withColumn("more", spans(F.col("t"), CANDIDATE, 3))
        .withColumn("every", hashed)
        .drop("t", "base", "more")
        .withColumn("row", F.monotonically_increasing_id())
    )
    rows = stage(scanned, "scanned")
    each = rows.select("row", "doc_id", "owner", F.explode("every").alias("span"))
    each = each.select("row", "doc_id", "owner", "span", F.col("span.hash").alias("hash"))
    holders = each.groupBy("hash", "owner", "doc_id").agg(F.count(F.lit(1)).alias("times"))
    owners = holders.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    owned = owners.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))
    many = (F.col("owners") > max_owners) | (F.col("repositories") > max_repositories)
    copied = stage(owned.filter(many).select("hash", F.lit(True).alias("copied")), "copied")
    judged = join_small(each.select("row", "span", "hash"), copied, "hash", salt_by="row", how="left")
    known = F.struct("span.start", "span.kind", "span.end", F.col("copied").isNull().alias("live"))
    by_row = judged.groupBy("row").agg(F.array_sort(F.collect_list(known)).alias("judged"))
    some = F.size("every") > 0
    none = rows.filter(~some).withColumn("judged", F.array().cast(by_row.schema["judged"].dataType))
    joined = rows.filter(some).join(by_row, "row").unionByName(none)
    part = lambda f: F.filter("judged", f)
    count = lambda f: F.size(part(f)).cast("long")
    listed = part(lambda s: (s["kind"] < 3) | s["live"])
    return joined.select(
        "doc_id",
        count(lambda s: s["kind"] == 0).alias("n_assign"),
        count(lambda s: s["kind"] == 1).alias("n_access"),
        count(lambda s: s["kind"] == 2).alias("n_hex"),
        F.sha2(_joined(part(lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        _joined(listed).alias("spans"),
        count(lambda s: (s["kind"] == 3) & s["live"]).alias("n_live"),
        count(lambda s: (s["kind"] == 3) & ~s["live"]).alias("n_copied"),
        _joined(part(lambda s: s["kind"] < 3), classes=True).alias("base_classes"),
        count(lambda s: (s["kind"] < 3) & s["live"]).alias("n_base_live"),
        count(lambda s: (s["kind"] < 3) & ~s["live"]).alias("n_base_copied"),
        F.transform(listed, lambda s: F.struct(s["start"], s["kind"], s["end"])).alias("found"),
        *(F.col(f"carried {c}").alias(c) for c in carry),
    )


def masked(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every run of overlapping spans replaced by ``mark``."""
    # each span gives what lies between it and the furthest end before it
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("parts"))
    between = lambda a, s: F.concat(
        a["parts"],
        F.when((s["start"] >= a["end"]), F.array(F.substring(text, a["end"] + 1, s["start"] - a["end"]))).otherwise(F.array().cast("array<string>")),
    )
    step = lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"), between(a, s).alias("parts"))
    close = lambda a: F.array_join(F.concat(a["parts"], F.array(F.substring(text, a["end"] + 1, F.length(text)))), mark)
    return F.when(F.size(found) > 0, F.aggregate(found, start, step, close)).otherwise(text)
