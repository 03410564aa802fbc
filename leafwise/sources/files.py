"""Files of a folder."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwise.functions.text import fold_newlines
from leafwise.operators.parsing import classify_files

# What a flat folder scan takes up.
INGEST_GLOBS = ("*.pdf", "*.docx")


def _glob(globs):
    return "{" + ",".join(globs) + "}" if len(globs) > 1 else globs[0]


def _named(files: DataFrame) -> DataFrame:
    # The source reports URIs; documents carry plain paths.
    path = F.regexp_replace("path", r"^file:/*(?=/)", "")
    return files.select(path.alias("file_path"), "content")


def scan_files(spark: SparkSession, root: str, recursive=False, globs=INGEST_GLOBS) -> DataFrame:
    """``(file_path, content)``; pass ``globs=()`` for every file, as a recursive scan does."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if globs:
        reader = reader.option("pathGlobFilter", _glob(globs))
    return _named(reader.load(root))


def stream_files(spark: SparkSession, root: str, globs=("*.txt",), max_files=None) -> DataFrame:
    """The same for files that arrive."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true")
    if globs:
        reader = reader.option("pathGlobFilter", _glob(globs))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _named(reader.load(root))


def decode_text(files: DataFrame) -> DataFrame:
    """``(file_path, file_type, text, error)`` of text files: UTF-8 without its bad bytes.

    Bad bytes are first replaced by U+FFFD and then removed, with which a genuine
    U+FFFD is lost too. A file of which nothing is left, though it has bytes, has an
    ``error``. Other types get a null text; their parts come from a decoder of the
    user's choice through ``assemble_parts``.
    """
    valid = F.make_valid_utf8(F.col("content").cast("string"))
    text = fold_newlines(F.translate(valid, "�", ""))
    decoded = classify_files(files).withColumn("text", F.when(F.col("file_type") == "txt", text))
    lost = (F.length("content") > 0) & (F.length("text") == 0)
    return decoded.select("file_path", "file_type", "text", F.when(lost, F.lit("no valid UTF-8")).alias("error"))
