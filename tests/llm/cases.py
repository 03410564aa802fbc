"""Documents with the awkward cases, beside a part of the given ones."""

import pyarrow.parquet as pq

SMALL = "/root/testdata/sf0.001"


def documents():
    """Rows ``(doc_id, text, lang, source)``: the given ones, nulls, empty, long and repeated ones, ties."""
    table = pq.read_table(f"{SMALL}/documents.parquet").to_pylist()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in table]
    words = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
    near = " ".join(f"n{i}" for i in range(200))
    rows += [
        (100_001, None, None, None),
        (100_002, "", "en", "src0"),
        (100_003, " \t\n ", None, "src1"),
        (100_004, "one", "en", None),
        (100_005, "one", "en", "src2"),
        (100_006, "two three four", "en", "src2"),
        (100_007, words, "en", "src2"),
        (100_008, words, "en", "src3"),
        (100_009, near, "en", "src3"),
        (100_010, near + " tail", "en", "src3"),
        (100_011, near + " tail of some more words", "de", "src3"),
        (100_012, "Ünïcödé ÀÉ 漢字  x   y  z\x00 Ab", "fr", "src3"),
        (100_012, "Ünïcödé ÀÉ 漢字  x   y  z\x00 Ab", "fr", "src3"),
        (100_013, "12345 --- 67", "en", "src3"),
    ]
    return rows


def frame(spark, rows):
    """With extra columns whose names the operators use inside."""
    wide = [(*r, "x", 1, "k", "row", "n", b"c") for r in rows]
    schema = "doc_id long, text string, lang string, source string, `class` string, part int, `key` string, row string, n string, bands binary"
    return spark.createDataFrame(wide, schema).repartition(5)


def empty(spark):
    return frame(spark, documents()[:1]).limit(0)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
