"""Queries against SQL, where there is some, and entry points."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from clientlens.llm.queries import ORACLE, QUERIES

SAMPLE = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SAMPLE}/{t}.parquet'")
    got = QUERIES[name](spark, SAMPLE)
    columns = sorted(got.columns)
    result = con.sql(ORACLE[name])
    assert sorted(result.columns) == columns
    want = sorted(map(str, con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})").fetchall()))
    assert sorted(str(tuple(r)) for r in got.select(*columns).collect()) == want


def test_registered():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
