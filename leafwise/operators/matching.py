"""From query texts to index terms."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwise.functions.arrays import run_lengths
from leafwise.functions.fuzzy import (
    letter_parity,
    max_edits,
    query_signatures,
    swap_distance,
    vocabulary_signatures,
)
from leafwise.functions.text import strip_ws, tokenize
from leafwise.plans.joins import join_small, top_per_group
from leafwise.plans.staging import stage
from leafwise.schema import FIELDS


def search_term():
    """The keyword if given, else the query."""
    return F.when(F.length("keyword") > 0, F.col("keyword")).otherwise(F.col("query"))


def is_blank():
    return F.length(strip_ws(F.coalesce(search_term(), F.lit("")))) == 0


def with_defaults(queries: DataFrame) -> DataFrame:
    """Fill in the optional columns of a query table."""
    defaults = {
        "query": F.lit(""),
        "keyword": F.lit(""),
        "search_fields": F.array(*[F.lit(f) for f in FIELDS]),
        "page": F.lit(1),
        "page_size": F.lit(20),
        "limit": F.lit(20),
    }
    present = {
        name: F.coalesce(F.col(name), value) if name in queries.columns else value
        for name, value in defaults.items()
    }
    return queries.select("query_id", *[value.alias(name) for name, value in present.items()])


def query_terms(queries: DataFrame) -> DataFrame:
    """Distinct terms of each query per searched field, with their multiplicity; narrow."""
    terms = run_lengths(F.sort_array(tokenize(search_term())))
    exploded = queries.filter(~is_blank()).select(
        "query_id", "search_fields", F.explode(terms).alias("t")
    )
    return exploded.select(
        "query_id",
        F.explode(F.array_distinct("search_fields")).alias("field"),
        F.col("t.value").alias("term"),
        F.col("t.n").cast("bigint").alias("mult"),
    )


def word_table(query_terms: DataFrame) -> DataFrame:
    """``(term, term_id, <field>_asked...)``: the distinct words of a batch, numbered.

    Staged, so that the numbers stay the same wherever the table is used.
    """
    asked = [F.max(F.col("field") == f).alias(f"{f}_asked") for f in FIELDS]
    words = query_terms.groupBy("term").agg(*asked)
    return stage(words.withColumn("term_id", F.monotonically_increasing_id()), "words")


def term_signatures(terms: DataFrame) -> DataFrame:
    """``(sig, expansion, expansion_parity)`` of index terms (``term``, distinct).

    Few bytes but much work per row: the partitions are set so that every core gets
    its part, however small the table. An index keeps them, as they depend on nothing
    but the term.
    """
    spark = terms.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    distinct = terms.select("term").repartition(parts, "term").distinct()
    signed = vocabulary_signatures(distinct.withColumn("expansion_parity", letter_parity(F.col("term"))))
    return signed.select("sig", F.col("term").alias("expansion"), "expansion_parity")


def expand_words(words: DataFrame, term_stats: DataFrame, limit: int | None = None, signatures: DataFrame | None = None) -> DataFrame:
    """``(field, term, term_id, expansion, weight, df, df_max)``, staged.

    Both sides are joined on signatures (see ``functions.fuzzy``), so a word meets
    only the few index terms that can lie within its edits, and similarity, which
    does not depend on the field, is found once per pair. The vocabulary is the big
    side and stays where it is when the signatures of the words fit a broadcast; an
    index has its ``signatures`` ready.
    """
    if signatures is None:
        longest = (words.agg(F.max(F.length("term"))).first()[0] or 0) + 2
        signatures = term_signatures(term_stats.filter(F.length("term") <= longest))
    wanted = query_signatures(words.select("term", letter_parity(F.col("term")).alias("parity")))
    near = F.abs(F.length("term") - F.length("expansion")) <= max_edits(F.col("term"))
    met = join_small(signatures, wanted, "sig", salt_by="expansion").filter(near)
    pairs = met.drop("sig").distinct()
    distance = swap_distance(
        F.col("term"), F.col("expansion"), F.col("parity"), F.col("expansion_parity")
    )
    shorter = F.least(F.length("term"), F.length("expansion"))
    # Exploding one element keeps the filter from evaluating the distance again.
    similar = pairs.withColumn("weight", F.explode(F.array(1 - distance / shorter))).filter("weight > 0")
    similar = stage(similar.select("term", "expansion", "weight"), "similar", compression="zstd")
    asked = words.select("term", "term_id", *[f"{f}_asked" for f in FIELDS])
    frequencies = term_stats.select("field", F.col("term").alias("expansion"), "df")
    # the field is looked at behind the join, so that a pair is there once for all fields
    known = join_small(join_small(frequencies, similar, "expansion", salt_by="df"), asked, "term", salt_by="expansion")
    in_field = F.coalesce(*[F.when(F.col("field") == f, F.col(f"{f}_asked")) for f in FIELDS])
    known = known.filter(in_field).select("field", "term", "term_id", "expansion", "weight", "df")
    return _best_expansions(known, limit)


def _best_expansions(known: DataFrame, limit: int | None) -> DataFrame:
    """The nearest index terms of each word and field, staged, and the frequency of the commonest."""
    order = [F.desc("weight"), F.asc("expansion")]
    best = known if limit is None else top_per_group(known, ["field", "term"], order, limit, salt_by="expansion").drop("rank")
    best = stage(best, "expansions", compression="zstd")
    commonest = stage(best.groupBy("field", "term").agg(F.max("df").alias("df_max")), "commonest")
    return join_small(best, commonest, ["field", "term"], salt_by="expansion").select(*best.columns, "df_max")


def exact_words(words: DataFrame, term_stats: DataFrame) -> DataFrame:
    """The same columns without fuzziness: every word stands for itself."""
    fields = F.array(*[F.when(F.col(f"{f}_asked"), F.lit(f)) for f in FIELDS])
    wanted = words.select("term", "term_id", F.explode(fields).alias("field")).filter("field is not null")
    known = join_small(term_stats, wanted, ["field", "term"])
    return stage(
        known.select(
            "field",
            "term",
            "term_id",
            F.col("term").alias("expansion"),
            F.lit(1.0).alias("weight"),
            "df",
            F.col("df").alias("df_max"),
        ),
        "expansions",
    )


def _per_query(query_terms: DataFrame, expanded: DataFrame) -> DataFrame:
    return join_small(query_terms, expanded, ["field", "term"], salt_by="query_id").select(
        "query_id", "field", "term", "mult", "expansion", "weight", "df"
    )


def fuzzy_expand(query_terms: DataFrame, term_stats: DataFrame, limit: int | None = None, signatures: DataFrame | None = None) -> DataFrame:
    """Index terms near each query term, at most the nearest ``limit`` per field, if given.

    A word is expanded once however many queries use it.
    """
    return _per_query(query_terms, expand_words(word_table(query_terms), term_stats, limit, signatures))


def exact_terms(query_terms: DataFrame, term_stats: DataFrame) -> DataFrame:
    """The same without fuzziness."""
    return _per_query(query_terms, exact_words(word_table(query_terms), term_stats))
