import pytest
from pyspark.sql import functions as F

from leafwise.functions.encoders import hash_encoder
from leafwise.operators import maintenance, parsing
from leafwise.plans.ingest import ingest_batch
from leafwise.plans.search import search_documents
from leafwise.plans.staging import stage
from leafwise.sources import documents as stored
from leafwise.sources import files, tables
from leafwise.streaming.ingest import stream_ingest


def write(folder, **named):
    folder.mkdir(parents=True, exist_ok=True)
    for name, data in named.items():
        (folder / name.replace("_", ".")).write_bytes(data)


def test_scans(spark, tmp_path):
    write(tmp_path, a_pdf=b"1", b_docx=b"2", c_txt=b"3")
    write(tmp_path / "sub", d_pdf=b"4")
    flat = {r["file_path"].rsplit("/", 1)[1] for r in files.scan_files(spark, str(tmp_path)).collect()}
    assert flat == {"a.pdf", "b.docx"}
    deep = files.scan_files(spark, str(tmp_path), recursive=True, globs=()).collect()
    assert len(deep) == 4 and all(r["file_path"].startswith(str(tmp_path)) for r in deep)


def test_decoding(spark, tmp_path):
    write(tmp_path, a_txt="Grüße\r\nzwei\rdrei".encode() + b"\xff\xfe!", b_pdf=b"%PDF")
    rows = {r["file_type"]: r["text"] for r in files.decode_text(files.scan_files(spark, str(tmp_path), globs=())).collect()}
    assert rows == {"txt": "Grüße\nzwei\ndrei!", "pdf": None}


def test_parts(spark):
    rows = [("/a.pdf", "pdf", 2, "two"), ("/a.pdf", "pdf", 1, "one"), ("/a.pdf", "pdf", 3, None), ("/b.docx", "docx", 1, "x"), ("/b.docx", "docx", 2, "y"), ("/c.pdf", "pdf", 1, None)]
    parts = spark.createDataFrame(rows, "file_path string, file_type string, part_no long, text string")
    found = {r["file_path"]: r["text"] for r in parsing.assemble_parts(parts).collect()}
    assert found == {"/a.pdf": "onetwo", "/b.docx": "x\ny", "/c.pdf": ""}
    assert parsing.parse_documents(parsing.assemble_parts(parts).drop("file_type")).count() == 2


def test_report_counts(spark):
    rows = [("/a.txt", "text", None), ("/b.xyz", "text", None), ("/c.txt", "", None), ("/d.txt", "t", "boom")]
    status = parsing.parse_status(spark.createDataFrame(rows, "file_path string, text string, error string"))
    assert tuple(parsing.ingest_report(status).first()) == (1, 1, 2)
    none = parsing.ingest_report(status.filter("false"))
    assert tuple(none.first()) == (0, 0, 0)
    assert tuple(parsing.ingest_message(none).first()) == ("No documents found", 0)


def test_upsert_is_idempotent(spark):
    schema = "id string, n int, v string"
    current = spark.createDataFrame([("a", 9, "old"), ("b", 1, "kept")], schema)
    incoming = spark.createDataFrame([("a", 1, "x"), ("a", 2, "new"), ("c", 1, "added")], schema)
    once = maintenance.upsert_documents(current, incoming, order="n")
    wanted = [("a", 2, "new"), ("b", 1, "kept"), ("c", 1, "added")]
    assert sorted(map(tuple, once.collect())) == wanted
    assert sorted(map(tuple, maintenance.upsert_documents(once, incoming, order="n").collect())) == wanted


def test_delete(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    assert [r["n"] for r in maintenance.delete_where(rows, F.col("s") == "a").collect()] == [2]
    assert maintenance.delete_where(rows).count() == 0


def batch(spark, *rows):
    return spark.createDataFrame([(f"/in/{i}.txt", t) for i, t in rows], "file_path string, text string")


def test_table_life(spark, tmp_path):
    path = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        stored.read_documents(spark, path)
    assert stored.create_table_if_absent(spark, path) and not stored.create_table_if_absent(spark, path)
    assert stored.read_documents(spark, path).count() == 0
    report = ingest_batch(batch(spark, ("a", "first"), ("b", "other"), ("c", "")), path, 0)
    assert tuple(report.first()) == (2, 0, 1)
    ingest_batch(batch(spark, ("a", "second")), path, 1)
    ingest_batch(batch(spark, ("a", "second")), path, 1)
    found = {r["id"]: r["content"] for r in stored.read_documents(spark, path).collect()}
    assert found == {"a": "second", "b": "other"}
    stored.delete_documents(spark, path, F.col("id") == "b", 0)
    for _ in range(2):
        found = {r["id"]: r["content"] for r in stored.read_documents(spark, path).collect()}
        assert found == {"a": "second"}
        stored.compact(spark, path)
    ingest_batch(batch(spark, ("b", "again")), path, 2)
    assert stored.read_documents(spark, path).count() == 2
    stored.delete_documents(spark, path, F.lit(True), 1)
    assert stored.read_documents(spark, path).count() == 0


def test_a_batch_replayed_after_compaction_loses_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    read = lambda: {r["id"]: r["content"] for r in stored.read_documents(spark, path).collect()}
    ingest_batch(batch(spark, ("a", "1"), ("b", "2")), path, 0)
    ingest_batch(batch(spark, ("c", "3")), path, 1)
    ingest_batch(batch(spark, ("c", "5")), path, 2)
    stored.compact(spark, path)
    ingest_batch(batch(spark, ("c", "4"), ("d", "4")), path, 1)  # older than batch 2, as before
    assert read() == {"a": "1", "b": "2", "c": "5", "d": "4"}
    stored.compact(spark, path)
    assert read() == {"a": "1", "b": "2", "c": "5", "d": "4"}


def test_a_batch_written_during_compaction_stays(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    ingest_batch(batch(spark, ("a", "1")), path, 0, writer="one")
    ingest_batch(batch(spark, ("b", "2")), path, 0, writer="two")
    write = stored._insert

    def meanwhile(rows, name, buckets):
        write(rows, name, buckets)
        if name.endswith("base"):
            monkeypatch.setattr(stored, "_insert", write)
            ingest_batch(batch(spark, ("d", "5"), ("b", "6")), path, 1, writer="two")

    monkeypatch.setattr(stored, "_insert", meanwhile)
    stored.compact(spark, path)
    assert {r["id"]: r["content"] for r in stored.read_documents(spark, path).collect()} == {"a": "1", "b": "6", "d": "5"}


def test_an_unfinished_base_is_not_read(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    ingest_batch(batch(spark, ("a", "1"), ("b", "2")), path, 0)
    monkeypatch.setattr(stored, "_publish", lambda *x: None)  # the job is lost before the log
    stored.compact(spark, path)
    assert {r["id"] for r in stored.read_documents(spark, path).collect()} == {"a", "b"}
    monkeypatch.undo()
    stored.compact(spark, path)
    assert {r["id"] for r in stored.read_documents(spark, path).collect()} == {"a", "b"}


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_only_the_batch_is_shuffled(spark, tmp_path, monkeypatch):
    """Reading joins base and changes bucket by bucket; a batch is dealt out by bucket, once."""
    path = str(tmp_path / "table")
    monkeypatch.setattr(stored, "BUCKETS", 4)
    ingest_batch(batch(spark, ("a", "1"), ("b", "2")), path, 0)
    stored.compact(spark, path)
    ingest_batch(batch(spark, ("b", "3")), path, 1)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exchanges(stored.read_documents(spark, path)) == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_opened_by_another_session(spark, tmp_path):
    path = str(tmp_path / "table")
    ingest_batch(batch(spark, ("a", "1")), path, 0)
    for name in ("base", "changes"):
        spark.sql(f"DROP TABLE {stored._name(path, name)}")  # the catalog of another session does not have them
    assert [r["id"] for r in stored.read_documents(spark, path).collect()] == ["a"]
    ingest_batch(batch(spark, ("a", "2")), path, 1)
    assert [r["content"] for r in stored.read_documents(spark, path).collect()] == ["2"]


def test_failed_files_are_counted_in_the_writing_pass(spark, tmp_path):
    write(tmp_path / "in", good_txt=b"text", broken_txt=b"\xff\xfe\xff", other_pdf=b"x")
    read = files.decode_text(files.scan_files(spark, str(tmp_path / "in"), globs=()))
    path = str(tmp_path / "table")
    assert tuple(ingest_batch(read.drop("file_type"), path, 0).first()) == (1, 1, 1)
    assert [r["id"] for r in stored.read_documents(spark, path).collect()] == ["good"]


def test_parts_are_merged_at_a_threshold(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "MAX_PARTS", 3)
    index, encoder = str(tmp_path / "index"), hash_encoder(16)
    for n in range(6):
        tables.add_to_index(parsing.parse_documents(batch(spark, (f"d{n}", f"word{n} same"), ("x", f"version{n}"))), index, encoder)
    part, first, _ = tables._log(spark, index)
    assert part == 6 and part - first < 3
    found = {(r["field"], r["term"]): r["df"] for r in tables.read_index(spark, index).term_stats.filter("field = 'content'").collect()}
    assert found[("content", "same")] == 6 and found[("content", "version5")] == 1 and ("content", "version4") not in found


def test_ingest_with_vectors(spark, tmp_path):
    path = str(tmp_path / "table")
    ingest_batch(batch(spark, ("a", "some words")), path, 0, encoder=hash_encoder(16))
    assert len(stored.read_documents(spark, path).first()["embedding"]) == 16


def test_an_ingested_batch_can_be_searched(spark, tmp_path):
    path, index, encoder = str(tmp_path / "table"), str(tmp_path / "index"), hash_encoder(16)

    def add(number, *rows):
        ingest_batch(batch(spark, *rows), path, number, encoder=encoder, index=index)

    first = batch(spark, ("a", "red apples"), ("b", "green pears"), ("d", "apples and pears"))
    ingest_batch(first, path, 0)
    tables.write_index(parsing.parse_documents(first), index, encoder, buckets=2)
    for _ in range(2):  # the second time as a replay
        add(1, ("a", "blue plums"), ("c", "more apples"), ("e", ""))
    asked = spark.createDataFrame([(0, "red apples"), (1, "plums")], "query_id long, query string")
    found = search_documents(asked, tables.read_index(spark, index), encoder, fuzzy=False, knn=False)
    assert {tuple(r) for r in found.select("query_id", "id").collect()} == {(0, "c"), (0, "d"), (1, "a")}
    add(2, ("e", ""))  # no document
    whole = tables.build_index(stage(stored.read_documents(spark, path), "documents"), encoder)
    parts = tables.read_index(spark, index)
    for name in ("term_stats", "field_stats", "postings", "vectors"):
        table = getattr(whole, name)
        rows = [sorted(map(str, df.select(*table.columns).collect())) for df in (table, getattr(parts, name))]
        assert rows[0] == rows[1], name
    with pytest.raises(ValueError):
        ingest_batch(batch(spark, ("a", "x")), path, 3, index=index)


def test_stream(spark, tmp_path):
    root, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        stream_ingest(spark, str(root), out, checkpoint, max_files=1).awaitTermination(120)
        return {r["id"]: r["content"] for r in stored.read_documents(spark, out).collect()}

    write(root, a_txt=b"one", b_txt=b"two", skip_pdf=b"x")
    assert run() == {"a": "one", "b": "two"}
    write(root / "later", a_txt=b"newer", c_txt=b"three")
    assert run() == {"a": "newer", "b": "two", "c": "three"}
    assert run() == {"a": "newer", "b": "two", "c": "three"}
    checkpoint = str(tmp_path / "another")  # starts to number its batches from 0
    assert set(run()) == {"a", "b", "c"}


def test_buckets_grow_with_the_documents(spark, monkeypatch):
    rows = spark.range(10).select(F.repeat(F.lit("x"), 10).alias("content"))
    assert stored.buckets_for(rows) == 4
    monkeypatch.setattr(stored, "BUCKET_BYTES", 7)
    assert stored.buckets_for(rows) == 15
    assert stored.buckets_for(rows.limit(0)) == 4
