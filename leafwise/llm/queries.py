"""Registered queries of the operators and their SQL counterparts."""

from pyspark.sql import functions as F

from leafwise.llm import (
    decontamination,
    language,
    manifest,
    near_duplicates,
    packing,
    prefix_forest,
    quality,
    scoring,
    secrets,
    sharding,
    sql,
    substrings,
    url_filters,
    whitening,
)


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rules of the URL filter: host, path, verdict.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op1_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op2_url_filters(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.judge_urls(_table(spark, sf_dir, "pages"), rules)


def op3_sharding(spark, sf_dir):
    return sharding.shard_rows(_table(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark, sf_dir):
    return near_duplicates.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark, sf_dir):
    return substrings.remove_repeated_passages(_table(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark, sf_dir):
    found = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("n_near")


def op7_secret_scans(spark, sf_dir):
    return secrets.scan_secrets(_table(spark, sf_dir, "documents")).drop("found")


def op7_secret_classes(spark, sf_dir):
    """What ``op7_secret_scans`` tells of the base spans' ownership."""
    return op7_secret_scans(spark, sf_dir).select("doc_id", "base_classes", "n_base_live", "n_base_copied")


def op8_quality_rules(spark, sf_dir):
    return quality.quality_rules(_table(spark, sf_dir, "documents"))


def op9_language_id(spark, sf_dir):
    training = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    return language.identify_languages(_table(spark, sf_dir, "documents"), training)


def op10_lm_scoring(spark, sf_dir):
    training = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    return scoring.score_documents(_table(spark, sf_dir, "documents"), training)


def op11_approximate_neighbours(spark, sf_dir):
    embeddings = _table(spark, sf_dir, "embeddings")
    return prefix_forest.nearest(embeddings, embeddings.filter("vec_id % 20 = 0"))


def op12_embedding_whitening(spark, sf_dir):
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark, sf_dir):
    """Where 2 divides the CRC of the id, the text is shown without its line feeds."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return manifest.merkle_manifest(_table(spark, sf_dir, "documents"), shown={"text": text})


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_url_filters, op3_sharding, op4_minhash_near_dedup, op5_substring_dedup, op6_benchmark_decontamination, op7_secret_scans, op7_secret_classes, op8_quality_rules, op9_language_id, op10_lm_scoring, op11_approximate_neighbours, op12_embedding_whitening, op13_merkle_manifest)}

#: Of the other queries' methods SQL has no counterpart; tests hold them against brute force.
SQL = {
    "op2_url_filters": sql.URL_FILTERS,
    "op4_minhash_near_dedup": sql.NEAR_DEDUP,
    "op5_substring_dedup": sql.SUBSTRING_DEDUP,
    "op6_benchmark_decontamination": sql.DECONTAMINATION,
    "op7_secret_scans": sql.SECRET_SCANS,
    "op7_secret_classes": f"SELECT doc_id, base_classes, n_base_live, n_base_copied FROM ({sql.SECRET_SCANS})",
    "op8_quality_rules": sql.QUALITY_RULES,
    "op13_merkle_manifest": sql.MANIFEST,
}
