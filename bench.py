"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from leafwise.functions.encoders import hash_encoder
from leafwise.operators.matching import fuzzy_expand, query_terms, with_defaults
from leafwise.plans.search import search_documents
from leafwise.plans.summaries import summarize
from leafwise.sources.tables import read_index, write_index
from workload import inputs
from workload.queries import REGISTERED


def run(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    work = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    encoder = hash_encoder()
    documents = spark.read.parquet(f"{folder}/documents.parquet").count()
    asked = inputs.queries(spark, folder)
    seconds = {}

    def timed(name, job):
        start = time.time()
        result = job()
        seconds[name] = round(time.time() - start, 3)
        return result

    run(inputs.parsed(spark, f"{folder}"))  # JVM warm-up
    timed("parse_documents", lambda: run(inputs.parsed(spark, folder)))
    timed(
        "index_build",
        lambda: write_index(inputs.parsed(spark, folder), f"{work}/index", encoder, buckets=8),
    )
    index = read_index(spark, f"{work}/index")
    terms = query_terms(with_defaults(asked))
    run(fuzzy_expand(terms, index.term_stats, signatures=index.signatures))  # warm-up of the search path
    timed("fuzzy_expand", lambda: run(fuzzy_expand(terms, index.term_stats, signatures=index.signatures)))
    timed("search_exact", lambda: run(search_documents(asked, index, encoder, fuzzy=False, knn=False)))
    timed("search_hybrid", lambda: run(search_documents(asked, index, encoder)))
    timed("summarize", lambda: run(summarize(asked, index, encoder)))
    for name in ("knn", "tokens", "sentences", "latest_upsert", "resolve_ids", "export_csv"):
        timed(name, lambda: run(REGISTERED[name](spark, folder)))
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
                "cpus": int(cpus),
                "documents": documents,
                "search_queries": asked.count(),
                "documents_per_sec_parsed": round(documents / seconds["parse_documents"]),
                "searches_per_sec": round(asked.count() / seconds["search_hybrid"], 2),
            }
        )
    )


if __name__ == "__main__":
    main()
