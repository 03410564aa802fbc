"""The registered queries against their SQL."""

import duckdb
import pyarrow as pa
import pytest

from leafwise.llm.queries import QUERIES, SQL
from leafwise.llm.secrets import scan_secrets
from tests.compare import connect, oracle_rows, spark_rows
from tests.llm.cases import SMALL, documents
from tests.llm.test_secrets import EXTRA


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SMALL)) == oracle_rows(connect(SMALL), SQL[name])


def test_ownership_by_sql(spark):
    """Operator and SQL agree on a table with candidates and base values, live and copied."""
    live, many = "Ab3dEf6hIj9kLm2nOp5q", "Qw1eRt2yUi3oPa4sDf5g"
    key, token = "AKIA" + "E" * 16, "c0ffee" * 5
    docs = documents() + EXTRA
    docs += [(400_000 + i, f"x {many} and {token} {live[::-1]}{i % 3}", "en", "src7") for i in range(14)]
    docs += [(400_100 + i, f"use {key} or token={token}", "en", f"src{i}") for i in range(3)]
    docs += [(400_200, f"password: {live} {live}", "en", "src1"), (400_201, f"hex {'ab12' * 9}, {'ab12' * 9}", "en", None), (None, f"{live}", "en", "src1")]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    con = duckdb.connect()
    con.register("documents", pa.table(dict(zip(("doc_id", "text", "lang", "source"), map(list, zip(*docs))))))
    found = spark_rows(scan_secrets(table).drop("found"))
    assert found == oracle_rows(con, SQL["op7_secret_scans"])
    counts = {c: sum(r[found[0].index(c)] for r in found[1]) for c in ("n_live", "n_copied", "n_base_live", "n_base_copied")}
    assert all(counts.values()), counts
