"""From raw documents to packed training sequences.

Each stage reads all that the one before kept, written as Parquet in the shared folder.
All but the last return the columns of ``documents``.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwise.llm import blooms, decontamination, language, near_duplicates, packing, secrets
from leafwise.plans.staging import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> list[str]:
    return [c for c in COLUMNS if c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents without letters, and those whose cosine with every language may be chance.

    Languages, and the length from which on a low cosine tells, are learned from all
    labelled documents of this stage. Shorter texts pass if they have a letter: clean
    ones have low cosines too. So do all with letters if too few are labelled. A long
    text in a language without labels goes. The columns stay as they are: ``lang`` is
    the label, not the prediction.
    """
    profile = stage(language.prototypes(docs), "profile")
    least = language.least_triples(language.nearest(docs.select("text", "lang").dropna(), profile))
    judged = language.nearest(docs.select(*_columns(docs)), profile)
    told = F.col("n_triples") > 0
    if least is not None:
        told &= (F.col("n_triples") < least) | (F.col("score") >= language.chance())
    return judged.filter(told).drop("lang_pred", "score", "n_triples")


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each group of near copies.

    Of rows that repeat an id and a text one stays. Rows without an id are kept unless
    they are copies of a row that has one. A Bloom filter lets the rows pass that surely
    stay. Of the others a second one, of those that stay nevertheless, drops the rest, so
    that few texts are shuffled.
    """
    key = F.xxhash64("text").alias("text_key")
    found = stage(near_duplicates.near_duplicates(docs.select("doc_id", "text", key), carry=("text_key",)), "found")
    each = found.groupBy("doc_id", "text_key").agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    going = stage(each.filter("NOT kept OR n > 1"), "going")
    blocks = blooms.blocks_for(going.count())
    mark = F.xxhash64("doc_id", "text_key")
    doubted = blooms.bloom_of(going, mark, blocks)
    spared = blooms.marked(each.filter("kept"), mark, doubted, blocks).filter("maybe")
    spared = stage(spared.select("doc_id", "text_key", "n"), "spared")
    names = _columns(docs)
    rows = blooms.marked(docs.select(*names, key), mark, doubted, blocks)
    more = blooms.blocks_for(spared.count())
    few = blooms.marked(rows.filter("maybe").drop("maybe"), mark, blooms.bloom_of(spared, mark, more), more).filter("maybe")
    doubtful = few.join(
        spared.select(F.col("doc_id").alias("id"), F.col("text_key").alias("k"), "n"),
        F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("k")),
    )
    one = doubtful.filter("n > 1").groupBy("doc_id", "text_key").agg(F.min(F.struct(*(c for c in names if c != "doc_id"))).alias("row"))
    stays = doubtful.filter("n = 1").select(*names)
    return rows.filter("NOT maybe").select(*names).unionByName(stays).unionByName(one.select("doc_id", "row.*").select(*names))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents of which benchmark passages make up a twentieth or more."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rest = [c for c in _columns(docs) if c != "doc_id"]
    judged = decontamination.contamination(docs, benchmark, carry=tuple(rest))
    return judged.filter(~F.col("contaminated")).select("doc_id", *rest)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask every base span and every candidate that looks live; copied candidates stay."""
    rest = [c for c in _columns(docs) if c != "doc_id"]
    found = secrets.scan_secrets(docs, carry=tuple(rest))
    text = secrets.masked(F.col("text"), F.col("found"))
    clean = found.withColumn("text", text)
    if "n_chars" in rest:
        clean = clean.withColumn("n_chars", F.when(F.size("found") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return clean.select("doc_id", *rest)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: Tokens, signatures and language profiles have no SQL; see the test against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
