"""Written intermediate tables.

A staged table cuts the lineage: later jobs read Parquet with column pruning and
pushed filters, and a lost executor costs a re-read, not a recomputation.
"""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Only a local session that has neither gets a temporary folder, once; on a
    cluster an unset folder is an error, because a machine-local one would be
    out of reach of the other machines.
    """
    context = spark.sparkContext
    folder = (
        spark.conf.get("spark.checkpoint.dir", None)
        or context.getConf().get("spark.checkpoint.dir", None)
        or context.getCheckpointDir()
    )
    if folder:
        return folder
    master = context.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="leafwise-"))
    return context.getCheckpointDir()


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; ``options`` are those of the writer."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), "leafwise", uuid.uuid4().hex, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a scan with fewer splits than cores; leave any other as it is.

    Meant for the scan at the start of CPU-heavy narrow work. A large input has far
    more splits than cores and is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
