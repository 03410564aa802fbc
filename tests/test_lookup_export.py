import csv
import glob
import json

import pytest

from leafwise.operators import exporting, lookup
from leafwise.sources.sinks import write_blocks, write_csv


@pytest.fixture(scope="module")
def documents(spark):
    rows = [
        ("a", 'Title "A", first', "/d/a.pdf", [f"H{i}" for i in range(9)], "b" * 5000, "s\nline"),
        ("b", None, "/d/b.pdf", None, None, None),
        ("c", "C", "/d/c.pdf", [], "", "scope"),
    ]
    return spark.createDataFrame(rows, "id string, title string, file_path string, headings array<string>, background string, scope string")


def fetch(spark, documents, *ids):
    asked = spark.createDataFrame(list(enumerate(ids)), "ord long, doc_id string")
    return lookup.fetch_by_ids(documents, asked)


def test_fetch_keeps_request_order(spark, documents):
    rows = fetch(spark, documents, "c", "missing", "a", "c").collect()
    assert [(r["ord"], r["id"]) for r in rows] == [(0, "c"), (2, "a"), (3, "c")]


def test_csv(spark, documents, tmp_path):
    rows = exporting.export(fetch(spark, documents, "a", "b"), "csv")
    assert rows.columns == ["Title", "File Path", "Background", "Scope", "Headings"]
    write_csv(rows, str(tmp_path / "out"))
    read = []
    for part in sorted(glob.glob(str(tmp_path / "out" / "*.csv"))):
        with open(part, newline="") as f:
            read += list(csv.DictReader(f))
    assert read[0]["Title"] == 'Title "A", first' and len(read[0]["Background"]) == 5000
    assert read[0]["Scope"] == "s\nline" and read[0]["Headings"] == " | ".join(f"H{i}" for i in range(9))
    assert read[1] == {"Title": "", "File Path": "/d/b.pdf", "Background": "", "Scope": "", "Headings": ""}


def test_report(spark, documents, tmp_path):
    found = fetch(spark, documents, "a", "b", "c")
    blocks = exporting.export(found, "pdf")
    rows = [tuple(r) for r in blocks.orderBy("ord", "block_no").collect()]
    assert rows[0] == (0, 1, "h1", 'Title "A", first') and rows[2] == (0, 3, "paragraph", "b" * 5000)
    assert [r[2] for r in rows] == ["h1", "h2", "paragraph", "h2", "paragraph", "page_break", "h1", "page_break", "h1", "h2", "paragraph"]
    assert rows[6][3] == "Untitled"
    with_summary = exporting.export(found, "docx", include_summary=True)
    assert with_summary.filter("text like '[Summary placeholder%'").count() == 3
    write_blocks(blocks, str(tmp_path / "report"))
    lines = [json.loads(x) for p in sorted(glob.glob(str(tmp_path / "report" / "*.json"))) for x in open(p)]
    assert [(x["ord"], x["block_no"]) for x in lines] == [r[:2] for r in rows]


def test_resolving(spark):
    names = ["src0-0.pdf", "src1-1.docx", "src3-3.pdf", "src5-5.pdf", "src6-6.DOCX", "both.pdf", "both.docx", "note.txt"]
    files = spark.createDataFrame([(f"/corpus/{n}",) for n in names], "file_path string")
    ids = ["src0-0", "src1-1", "missing", "src0-0", "src5-5.pdf", "c3-3", "x-src1-1-y", "src6-6", "both", "note.txt", "note", ""]
    asked = spark.createDataFrame(list(enumerate(ids)), "ord long, doc_id string")
    rows = lookup.resolve_document_ids(files, asked).orderBy("ord").collect()
    found = [(r["file_path"].split("/")[-1], r["match_rank"]) if r["file_path"] else None for r in rows]
    assert found == [
        ("src0-0.pdf", 1),
        ("src1-1.docx", 2),
        None,
        ("src0-0.pdf", 1),
        ("src5-5.pdf", 3),
        ("src3-3.pdf", 4),
        ("src1-1.docx", 4),
        None,
        ("both.pdf", 1),
        ("note.txt", 3),
        None,
        None,
    ]
