"""Every registered query against its SQL, which is written without our reductions."""

from __future__ import annotations

import duckdb
import pytest
from compare import SAMPLE, SAMPLE_VIEWS, duckdb_table, spark_table

from clientlens.plans.catalog import BUILDERS, CATALOG
from clientlens.plans.oracle import ORACLE


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for name in SAMPLE_VIEWS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SAMPLE}/{name}.parquet'")
    return con


def test_every_query_has_an_oracle():
    assert set(CATALOG) == set(ORACLE)


@pytest.mark.parametrize("name", list(CATALOG))
def test_query_matches_sql(name, spark, connection):
    assert spark_table(CATALOG[name](spark, SAMPLE)) == duckdb_table(connection, ORACLE[name])


@pytest.mark.parametrize("name", ["k13_kpi_metrics_sliced", "l3_client_listing", "r2_outstanding_by_client"])
def test_query_matches_sql_on_snapshots(name, snapshots, connection):
    """The same from Parquet snapshots in year folders."""
    assert spark_table(BUILDERS[name](snapshots)) == duckdb_table(connection, ORACLE[name])
