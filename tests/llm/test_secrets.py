import hashlib
import re

from pyspark.sql import functions as F

from leafwise.llm import secrets
from tests.llm.cases import documents, empty, frame, rows

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
COLUMNS = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]

LIVE = "Ab3dEf6hIj9kLm2nOp5q"
COPIED = "zY8xWv7uTs6rQp5oNm4l"
EXTRA = [
    (300_001, f"é token = '{'a' * 6}' x AKIA{'B' * 16} {'0a' * 13} end", "en", "src1"),
    (300_002, "secret=short secret=token: abcdefgh PassWord:\"qwertyuiop\" apikey=1 api_key = 123456", "en", "src1"),
    (300_003, f"AKIA1 AKIAAKIA{'C' * 20}x {'f' * 23} {'f' * 24}g deadbeef", "en", "src1"),
    (300_004, f"𝒜 code {LIVE} here", "en", "src1"),
    (300_005, f"code {LIVE} again, and {COPIED}", "en", "src1"),
    (300_006, f"sample {COPIED}", "en", "src2"),
    (300_007, "token=" + "a1" * 5000 + " " + "0123456789abcdef" * 3 + " k" * 5000, "en", "src2"),
    (300_008, " ".join(f"passwd=abcdef{i}" for i in range(700)), "en", "src2"),
]


def base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(found)


def joined(found):
    return ",".join(f"{('assign', 'access', 'hex', 'live')[k]}:{a}:{b}" for a, k, b in found)


def test_base_against_python(spark):
    cases = documents() + EXTRA
    found = rows(secrets.scan_secrets(frame(spark, cases)), *COLUMNS)
    wanted = []
    for doc_id, text, *_ in cases:
        spans = base(text or "")
        counts = [sum(k == kind for _, k, _ in spans) for kind in range(3)]
        wanted.append((doc_id, *counts, hashlib.sha256(joined(spans).encode()).hexdigest()))
    assert found == sorted(wanted, key=repr)


def test_owners_tell_live_from_copied(spark):
    found = {r["doc_id"]: r for r in secrets.scan_secrets(frame(spark, EXTRA)).collect()}
    assert found[300_004]["spans"] == "live:7:27"
    assert found[300_005]["spans"] == "live:5:25" and found[300_005]["n_copied"] == 1
    assert found[300_006]["spans"] == "" and found[300_006]["n_copied"] == 1
    assert found[300_001]["spans"] == joined(base(EXTRA[0][1]))


def test_base_spans_have_classes(spark):
    """An assigned value, access key or hex value of several owners is copied, whatever stands before it."""
    example, own, token = "AKIA" + "E" * 16, "AKIA" + "F" * 16, "c0ffee" * 5
    docs = [
        (1, f"key {example} and {own}", "en", "src1"),
        (2, f"key {example} Password='{token}'", "en", "src2"),
        (3, f"see {token} api_key: hunter22", "en", "src3"),
        (4, f"secret={COPIED}", "en", "src1"),
        (5, f"sample {COPIED}", "en", "src2"),
        (6, "nothing", "en", "src2"),
    ]
    found = {r["doc_id"]: r for r in secrets.scan_secrets(frame(spark, docs)).collect()}
    assert found[1]["base_classes"] == "access:4:24:copied,access:29:49:live"
    assert found[2]["base_classes"] == "access:4:24:copied,assign:25:65:copied,hex:35:65:copied"
    assert found[3]["base_classes"] == "hex:4:34:copied,assign:35:52:live"
    assert found[4]["base_classes"] == "assign:0:27:copied" and found[5]["n_copied"] == 1
    assert found[6]["base_classes"] == found[6]["spans"] == ""
    assert [(found[i]["n_base_live"], found[i]["n_base_copied"]) for i in range(1, 7)] == [(1, 1), (0, 3), (1, 1), (0, 1), (0, 0), (0, 0)]
    assert all(found[d[0]]["base_sha256"] == hashlib.sha256(joined(base(d[1])).encode()).hexdigest() for d in docs)
    assert all(found[d[0]]["spans"] == joined(base(d[1])) for d in docs)


def test_many_repositories_of_one_owner_are_copies(spark):
    """Repositories are told apart by id: a value that one document repeats stays live."""
    most = secrets.MAX_REPOSITORIES
    docs = [(i, f"code {COPIED} end", "en", "hot") for i in range(most + 1)]
    docs += [(100 + i, f"code {LIVE} end", "en", "hot") for i in range(most)] + [(100, f"code {LIVE} end", "en", "hot")]
    docs += [(200, f"AKIA{'D' * 16} " * 50, "en", "hot")] + [(300 + i, f"token={'ab1' * 4}", "en", "hot") for i in range(most + 1)]
    found = secrets.scan_secrets(frame(spark, docs), carry=("text",)).withColumn("masked", secrets.masked(F.col("text"), F.col("found")))
    for r in found.collect():
        if r["doc_id"] < 100:
            assert (r["n_live"], r["n_copied"], r["masked"]) == (0, 1, r["text"])
        elif r["doc_id"] < 200:
            assert (r["n_live"], r["n_copied"], r["masked"]) == (1, 0, "code [SECRET] end")
        elif r["doc_id"] == 200:
            assert (r["n_base_live"], r["n_base_copied"]) == (50, 0)
        else:
            assert (r["n_base_live"], r["n_base_copied"], r["masked"]) == (0, 1, "[SECRET]")
    kept = secrets.scan_secrets(frame(spark, docs), max_repositories=most + 1)
    assert {(r["n_copied"], r["n_base_copied"]) for r in kept.collect()} == {(0, 0)}


def test_masking(spark):
    docs = frame(spark, EXTRA[:3] + [(1, None, None, None), (2, "plain", "en", "s")])
    found = secrets.scan_secrets(docs, carry=("text",)).withColumn("masked", secrets.masked(F.col("text"), F.col("found")))
    text = {r["doc_id"]: r["masked"] for r in found.collect()}
    assert text[300_001] == "é [SECRET]' x [SECRET] [SECRET] end"
    assert text[2] == "plain" and text[1] is None
    assert text[300_002] == 'secret=short secret=token: abcdefgh [SECRET]" apikey=1 [SECRET]'


def test_empty_table(spark):
    assert secrets.scan_secrets(empty(spark)).collect() == []
