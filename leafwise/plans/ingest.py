"""From files or texts to a stored document table."""

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from leafwise.operators.maintenance import latest
from leafwise.operators.parsing import embedding_text, file_status, ingest_report, parse_documents, parse_status
from leafwise.sources.documents import append_batch, create_table_if_absent, read_batch
from leafwise.sources.tables import add_to_index


def ingest_batch(files: DataFrame, path: str, batch: int, as_of=None, writer: str = "main", encoder=None, index: str | None = None) -> DataFrame:
    """Parse ``(file_path, text[, error])``, write the documents as a batch, return the counts.

    Of several files with one id the last by path stays, as when they are written
    one after another. A file with an ``error`` gives no document and counts as failed.
    The counts are observed while the batch is written, so files are read once. With an
    ``encoder`` the documents are stored with their vectors. Batches are numbered for
    each ``writer`` on its own. With the path of an ``index`` the batch can be searched
    at once, and its ids' earlier documents no longer.
    """
    if index and not encoder:
        raise ValueError("an index needs an encoder")
    spark = files.sparkSession
    create_table_if_absent(spark, path)
    seen = Observation()
    counts = [F.count_if(file_status(files) == s).alias(s) for s in ("success", "failed", "skipped")]
    read = files.observe(seen, *counts)
    sound = read.filter(F.col("error").isNull()).drop("error") if "error" in files.columns else read
    documents = parse_documents(sound, as_of)
    vector = encoder(embedding_text()) if encoder else F.lit(None)
    label = append_batch(documents.withColumn("embedding", vector.cast("array<float>")), path, batch, writer)
    if index:
        written = read_batch(spark, path, label).drop("embedding")
        add_to_index(latest(written, "id", [F.desc("file_path")]), index, encoder)
    try:
        found = seen.get
    except Py4JJavaError:  # a table of constants without documents: nothing ran that could be observed
        return ingest_report(parse_status(files))
    return spark.createDataFrame([tuple(found[s] for s in ("success", "failed", "skipped"))], "success bigint, failed bigint, skipped bigint")
