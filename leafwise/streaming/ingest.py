"""Ingest of files as they arrive."""

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwise.plans.ingest import ingest_batch
from leafwise.sources.files import decode_text, stream_files


def stream_ingest(
    spark: SparkSession,
    root: str,
    out: str,
    checkpoint: str,
    globs=("*.txt",),
    max_files=None,
    decode=decode_text,
    encoder=None,
    index: str | None = None,
):
    """Parse new files below ``root`` and upsert them into the document table ``out``.

    Runs over what is there and stops; started again, it takes up only new files.
    A batch is known by its checkpoint and the micro-batch's number, so a replayed
    micro-batch overwrites itself and streams do not overwrite each other. ``decode`` turns ``(file_path, content)`` into
    ``(file_path, file_type, text)`` and may be the user's own for binary formats. With
    the path of an ``index`` (and an ``encoder``) each micro-batch is searchable once written.
    """

    writer = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def write(files: DataFrame, batch: int) -> None:
        ingest_batch(decode(files).drop("file_type"), out, batch, F.current_timestamp(), writer, encoder, index)

    stream = stream_files(spark, root, globs, max_files).writeStream.foreachBatch(write)
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
