"""URL filters and sharding."""

import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from leafwise.llm import sharding
from leafwise.llm.queries import URL_RULES
from leafwise.llm.url_filters import judge_urls
from tests.llm.cases import SMALL, documents, empty, frame, rows

URLS = [
    None, "", "no scheme", "http://", "://x.org/a", "HTTP://WWW.Example.ORG/es/x?y#z", "https://example.org/es", "https://notexample.org/es/1",
    "https://a.b.example.org/en/12/x", "https://a.b.example.org/en/2", "https://shop.COM/fr/", "https://shop.com/de/q#f", "https://com/de/",
    "https://org", "https://x.org?/es/", "https://example.org:80/es/", "ftp://x://y.org/", "https://ÄÖ.org/ü", "https://.org/", "https://" + "a." * 3000 + "org/" + "p" * 9000,
]


def judged(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def pages(spark):
    made = [(i, u, "h", "x", 1) for i, u in enumerate(URLS)] * 2
    return spark.createDataFrame(made, "page_id long, url string, host string, `row` string, path int").repartition(4)


def test_urls_against_python(spark):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    found = rows(judge_urls(pages(spark), rules), "page_id", "host", "path", "rule", "verdict")
    assert found == sorted(((i, *judged(u, URL_RULES)) for i, u in enumerate(URLS) for _ in range(2)), key=repr)


def test_long_list_with_a_small_filter(spark):
    """False positives of a filter that is far too small do not reach the result."""
    listed = [(f"h{i}.net", f"/{i % 7}", "block") for i in range(3000)] + [("net", "", "allow"), (None, "/", "block"), ("net", "", "allow")]
    urls = [(i, f"http://x.h{i}.net/{i % 5}/a", "", "", 0) for i in range(0, 6000, 7)]
    made = spark.createDataFrame(urls, "page_id long, url string, host string, `row` string, path int")
    rules = spark.createDataFrame(listed, "host string, path string, verdict string")
    found = rows(judge_urls(made, rules, max_blocks=8), "page_id", "host", "path", "rule", "verdict")
    clean = [r for r in listed if r[0]]
    assert found == sorted(((u[0], *judged(u[1], clean)) for u in urls), key=repr)


def test_no_rules_and_no_pages(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r["verdict"] for r in judge_urls(pages(spark), none).collect()} == {"allow"}
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    assert judge_urls(pages(spark).limit(0), rules).collect() == []


def test_shards(spark):
    docs = documents() + [(9, "copy", "en", "s")] * 300 + [(None, None, None, None)] * 3
    found = sharding.shard_rows(frame(spark, docs), shards=7).collect()
    wanted = sorted(((d[0], len((d[1] or "").encode()) + 8, zlib.crc32((d[1] or "").encode())) for d in docs), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in found), key=repr) == wanted
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[k]) for k in range(7)]
    assert max(counts) - min(counts) <= 1
    again = sharding.shard_rows(frame(spark, docs[::-1]).repartition(3), shards=7).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))


def test_permutation(spark):
    for n in (1, 2, 3, 10, 97, 1000, 4097):
        places = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 5)).collect()]
        assert sorted(places) == list(range(n))
        assert n < 10 or places != list(range(n))
    assert sharding.shard_rows(empty(spark)).collect() == []
