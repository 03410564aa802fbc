"""Document tables: two bucketed Spark tables below one folder.

``base`` holds one row per id, ``changes`` the rows of batches written since, with
tombstones for deleted ids. Both are bucketed and sorted by id with the same number of
buckets, so that reading joins them without a shuffle, and writing a batch shuffles the
batch only. A batch is a partition of ``changes``: written again it replaces itself.
Rows carry the number of the writing (``seq``), and the highest of an id counts.
``compact`` writes the current rows as a new partition of ``base``.

The session catalog knows the tables by a name made from the folder; any session can
open them again, as the folder's ``log`` tells the buckets and the newest base.
"""

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwise.plans.staging import stage
from leafwise.schema import DOCUMENTS

BUCKETS = 16
# Bytes of content in a bucket, which one task reads.
BUCKET_BYTES = 32 << 20
LOG = "generation int, buckets int"


def _log(spark: SparkSession, path: str):
    """The newest base and the number of buckets; null without a table."""
    try:
        rows = spark.read.schema(LOG).parquet(f"{path}/log").collect()
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return None
    return max((r["generation"], r["buckets"]) for r in rows) if rows else None


def _publish(spark: SparkSession, path: str, generation: int, buckets: int) -> None:
    spark.createDataFrame([(generation, buckets)], LOG).coalesce(1).write.mode("append").parquet(f"{path}/log")


def _name(path: str, table: str) -> str:
    return f"leafwise_{hashlib.md5(path.encode()).hexdigest()}_{table}"


def _open(spark: SparkSession, path: str, table: str, schema: T.StructType, more: str, partition: str, buckets: int) -> str:
    """The table's name, known to the catalog and up to date."""
    name = _name(path, table)
    columns = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), more])
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet OPTIONS (partitionOverwriteMode 'dynamic') "
        f"PARTITIONED BY ({partition}) CLUSTERED BY (id) SORTED BY (id) INTO {buckets} BUCKETS LOCATION '{path}/{table}'"
    )
    spark.catalog.recoverPartitions(name)  # those that other sessions wrote
    spark.catalog.refreshTable(name)
    return name


def _base(spark, path, schema, buckets) -> str:
    return _open(spark, path, "base", schema, "seq bigint, generation int", "generation", buckets)


def _changes(spark, path, schema, buckets) -> str:
    return _open(spark, path, "changes", schema, "seq bigint, deleted boolean, batch string", "batch", buckets)


def buckets_for(documents: DataFrame, least: int = 4) -> int:
    """Buckets of a table of about these documents; each task sends on its own sum only."""
    size = documents.agg(F.sum(F.octet_length("content").cast("bigint"))).first()[0] or 0
    return max(least, -(-size // BUCKET_BYTES))


def _insert(rows: DataFrame, name: str, buckets: int) -> None:
    """Write by bucket: one shuffle, of ``rows``. A partition that is there is replaced."""
    columns = rows.sparkSession.table(name).columns
    rows.select(*columns).repartition(buckets, "id").write.insertInto(name, overwrite=True)


def create_table_if_absent(spark: SparkSession, path: str, schema=DOCUMENTS, buckets: int = BUCKETS) -> bool:
    """Create an empty table; false when there is one already."""
    if _log(spark, path):
        return False
    for table, partition in (("base", "generation int"), ("changes", "batch string")):  # folders without rows
        spark.createDataFrame([], f"id string, {partition}").write.mode("append").partitionBy(partition.split()[0]).parquet(f"{path}/{table}")
    _publish(spark, path, 0, buckets)
    _base(spark, path, schema, buckets)
    _changes(spark, path, schema, buckets)
    return True


def _tables(spark: SparkSession, path: str, schema) -> tuple[DataFrame, DataFrame, int, int]:
    log = _log(spark, path)
    if log is None:
        raise FileNotFoundError(path)
    generation, buckets = log
    base = spark.table(_base(spark, path, schema, buckets)).filter(F.col("generation") == generation).drop("generation")
    return base, spark.table(_changes(spark, path, schema, buckets)), generation, buckets


def _number(base: DataFrame, changes: DataFrame, label: str) -> int:
    """The number of a writing: its own if the batch was written before, else the next one."""
    own = F.max(F.when(F.col("batch") == label, F.col("seq")))
    known, last = changes.agg(own, F.max("seq")).first()
    if known is not None:
        return known
    return 1 + max(last or 0, base.agg(F.max("seq")).first()[0] or 0)


def append_batch(incoming: DataFrame, path: str, batch: int, writer: str = "main", schema=DOCUMENTS) -> str:
    """Write a batch of ``writer``; the same number of the same writer again replaces it.

    Of several rows with one id the last by ``file_path`` counts. Writers (streams)
    number their batches independently. Returns the batch's name.
    """
    base, changes, _, buckets = _tables(incoming.sparkSession, path, schema)
    label = f"{writer}-{batch}"
    rows = incoming.withColumns({"seq": F.lit(_number(base, changes, label)).cast("bigint"), "deleted": F.lit(False), "batch": F.lit(label)})
    _insert(rows, _name(path, "changes"), buckets)
    return label


def read_batch(spark: SparkSession, path: str, label: str, schema=DOCUMENTS) -> DataFrame:
    """The rows of one batch as they were written."""
    _, changes, _, _ = _tables(spark, path, schema)
    return changes.filter((F.col("batch") == label) & ~F.col("deleted")).select(*schema.names)


def _current(spark: SparkSession, path: str, schema) -> DataFrame:
    """The current rows with ``seq``; no shuffle, as all steps go by bucket."""
    base, changes, _, _ = _tables(spark, path, schema)
    order = [F.desc("seq")] + [F.desc("file_path")] * ("file_path" in schema.names)
    newest = Window.partitionBy("id").orderBy(*order)
    last = changes.withColumn("n", F.row_number().over(newest)).filter("n = 1").drop("n", "batch")
    written = base.select("id", F.col("seq").alias("base_seq"))
    live = last.join(written, "id", "left").filter(F.coalesce(F.col("seq") > F.col("base_seq"), F.lit(True))).drop("base_seq")
    columns = [*schema.names, "seq"]
    kept = base.join(live.select("id"), "id", "left_anti")
    return kept.select(*columns).unionByName(live.filter(~F.col("deleted")).select(*columns))


def read_documents(spark: SparkSession, path: str, schema=DOCUMENTS) -> DataFrame:
    """The current rows: of each id the one written last."""
    return _current(spark, path, schema).drop("seq")


def delete_documents(spark: SparkSession, path: str, predicate, batch: int, writer: str = "delete", schema=DOCUMENTS) -> None:
    """Delete the documents that match: their ids are written as tombstones, as a batch like any other."""
    gone = _current(spark, path, schema).filter(F.coalesce(predicate, F.lit(False))).select("id")
    base, changes, _, buckets = _tables(spark, path, schema)
    label = f"{writer}-{batch}"
    number = _number(base, changes, label)
    none = {f.name: F.lit(None).cast(f.dataType) for f in schema if f.name != "id"}
    rows = stage(gone, "deleted").withColumns({**none, "seq": F.lit(number).cast("bigint"), "deleted": F.lit(True), "batch": F.lit(label)})
    _insert(rows, _name(path, "changes"), buckets)


def compact(spark: SparkSession, path: str, schema=DOCUMENTS) -> None:
    """Write the current rows as a new base, which is read once it is complete.

    Batches stay; those the base has are older than its rows and count no more, one
    that is written meanwhile is newer. A replayed batch keeps its number, so it brings
    nothing old back.
    """
    _, _, generation, buckets = _tables(spark, path, schema)
    rows = _current(spark, path, schema).withColumn("generation", F.lit(generation + 1))
    _insert(rows, _name(path, "base"), buckets)
    _publish(spark, path, generation + 1, buckets)
