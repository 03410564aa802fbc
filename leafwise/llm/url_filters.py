"""URL filters: a blocked Bloom filter before an exact hash join.

The listed canonical URLs are pairs of a host and the start of a path. A URL may be
covered by any pair of (its host or a parent domain, a start of its path), of which
only those with a number of labels and a path length that occur in the list are
looked up, first in a Bloom filter of bounded size (see ``blooms``). What passes is
joined with the list itself, which removes false positives.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwise.llm import blooms
from leafwise.plans.joins import fits_broadcast
from leafwise.plans.staging import stage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    place = F.locate("://", url)
    rest = F.substring(url, place + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), _UPPER, _LOWER)
    return F.when(place > 0, host).otherwise(F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    place = F.locate("://", url)
    rest = F.substring(url, place + 3, F.length(url))
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.when(place > 0, path).otherwise(F.lit(""))


def _key(host: Column, path: Column) -> Column:
    return F.xxhash64(host, path)


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    otherwise: str = "allow",
    max_blocks: int = blooms.MAX_BLOCKS,
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages``.

    ``rules``: ``host, path, verdict``. A rule fits its host and all subdomains when
    the path starts with the rule's; of several the longest (host and path together)
    wins, then the one that sorts last. A URL that no rule fits is not listed and
    gets ``otherwise``. Rules with a null part are ignored, repeated ones count once.
    A null or empty URL, or one without ``://``, has an empty host and path.
    """
    pages_ = pages.select(F.col(f"`{id_column}`").alias("page_id"), F.col(f"`{url_column}`").alias("url"))
    pages_ = pages_.select("page_id", url_host(F.coalesce("url", F.lit(""))).alias("host"), url_path(F.coalesce("url", F.lit(""))).alias("path"))
    listed = rules.select("host", "path", "verdict").dropna().groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    labels = F.size(F.split("host", r"\."))
    facts = listed.agg(
        F.count(F.lit(1)).alias("n"),
        F.collect_set(labels).alias("labels"),
        F.collect_set(F.length("path")).alias("lengths"),
    ).first()
    if not facts["n"]:
        return pages_.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    blocks = blooms.blocks_for(facts["n"], max_blocks)

    # keys that may be listed: parent domains by their number of labels, path starts by length
    parts = F.split("host", r"\.")
    hosts = F.filter(
        F.array(*(F.when(F.size(parts) >= n, F.concat_ws(".", F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n))) for n in sorted(facts["labels"]))),
        lambda h: h.isNotNull(),
    )
    lengths = F.array(*(F.lit(n) for n in sorted(facts["lengths"])))
    starts = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.col("path").substr(F.lit(1), n))
    pairs = F.flatten(F.transform(hosts, lambda h: F.transform(starts, lambda p: F.struct(h.alias("h"), p.alias("p")))))
    rows = stage(pages_.withColumn("row", F.monotonically_increasing_id()), "urls")
    probes = rows.select("row", F.explode(pairs).alias("pair")).select("row", F.col("pair.h").alias("host"), F.col("pair.p").alias("path"))
    key = _key(F.col("host"), F.col("path"))
    bloom = blooms.bloom_of(listed, key, blocks)
    possible = blooms.marked(probes, key, bloom, blocks).filter("maybe").select("row", "host", "path")
    exact = listed.select("host", "path", F.struct((F.length("host") + F.length("path")).alias("size"), F.concat("host", "path").alias("rule"), "verdict").alias("found"))
    side = F.broadcast(exact) if fits_broadcast(exact) else exact
    best = possible.join(side, ["host", "path"]).groupBy("row").agg(F.max("found").alias("found"))
    return rows.join(best, "row", "left").select(
        "page_id",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.lit(otherwise)).alias("verdict"),
    )
