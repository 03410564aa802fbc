"""Documents and files by requested id."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwise.functions.text import base_name, file_stem
from leafwise.operators.containment import least_match
from leafwise.plans.joins import join_small
from leafwise.plans.staging import stage

# Types that can be looked up, case-sensitively, in order of preference.
LOOKUP_TYPES = (".pdf", ".docx")


def fetch_by_ids(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """``(ord, document columns)`` in request order; repeats repeat, unknown ids vanish.

    What was asked for is staged: sorting reads its input twice, to find ranges first. A
    sink that sorts by ``ord`` again takes the place of this order.
    """
    asked = ids.select("ord", F.col("doc_id").alias("id"))
    joined = stage(join_small(documents, asked, "id", salt_by="id").select("ord", *documents.columns), "fetched")
    return joined.orderBy("ord")


def _best(candidates):
    """One file per request: lowest match rank, then file name; combined map-side."""
    best = F.min(F.struct("match_rank", "file_name", "file_path")).alias("best")
    return candidates.groupBy("ord", "doc_id").agg(best)


def resolve_document_ids(files: DataFrame, ids: DataFrame) -> DataFrame:
    """``(ord, doc_id, file_path, match_rank)``: the file each requested id stands for.

    In turn: the id with ``.pdf``, with ``.docx``, as a file name, and last any PDF or
    DOCX file whose stem contains the id or is contained in it. The first three are
    equi-joins, the last one reads distinct stems and the ids still open with automata.
    """
    names = files.select(
        "file_path",
        base_name(F.col("file_path")).alias("file_name"),
        file_stem(F.col("file_path")).alias("stem"),
    )
    asked = ids.select("ord", "doc_id").filter(F.length("doc_id") > 0)
    guesses = asked.select(
        "ord",
        "doc_id",
        F.posexplode(
            F.array(*[F.concat("doc_id", F.lit(suffix)) for suffix in LOOKUP_TYPES], F.col("doc_id"))
        ).alias("position", "file_name"),
    )
    exact = stage(
        _best(join_small(names, guesses, "file_name", salt_by="file_path").withColumn("match_rank", F.col("position") + 1)), "exact_ids"
    )
    open_ids = stage(asked.join(exact.select("ord"), "ord", "left_anti"), "open_ids")
    by_type = F.lit(False)
    for suffix in LOOKUP_TYPES:
        by_type = by_type | F.col("file_name").endswith(suffix)
    candidates = names.filter(by_type)

    value = F.min(F.struct("file_name", "file_path")).alias("value")
    stems = stage(candidates.filter(F.length("stem") > 0).groupBy("stem").agg(value), "stems")
    wanted = open_ids.select("doc_id").distinct()
    stem_holds_id = least_match(stems.withColumnRenamed("stem", "text"), wanted.withColumnRenamed("doc_id", "pattern"), by="pattern")
    id_holds_stem = least_match(wanted.withColumnRenamed("doc_id", "text"), stems.withColumnRenamed("stem", "pattern"), by="text")
    loose = stem_holds_id.withColumnRenamed("pattern", "doc_id").unionByName(id_holds_stem.withColumnRenamed("text", "doc_id"))
    loose = loose.groupBy("doc_id").agg(F.min("value").alias("value"))
    contained = join_small(open_ids, loose, "doc_id", salt_by="ord").select(
        "ord", "doc_id", F.struct(F.lit(4).alias("match_rank"), "value.file_name", "value.file_path").alias("best")
    )

    found = exact.unionByName(contained).select(
        "ord", F.col("best.file_path").alias("file_path"), F.col("best.match_rank").cast("int").alias("match_rank")
    )
    return ids.select("ord", "doc_id").join(found, "ord", "left").select(
        "ord", "doc_id", "file_path", "match_rank"
    )
