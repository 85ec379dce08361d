"""Order-free comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import math
import os

SAMPLE = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SAMPLE_VIEWS = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "isoformat"):
        return str(value)[:19].replace(" 00:00:00", "")
    return value


def table(columns, rows) -> list[tuple]:
    """Rows with their columns in name order, sorted."""
    order = [columns.index(c) for c in sorted(columns)]
    cells = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(cells, key=lambda row: [(v is None, str(v)) for v in row])


def spark_table(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), table(df.columns, [tuple(r) for r in df.collect()])


def duckdb_table(connection, sql) -> tuple[list[str], list[tuple]]:
    cursor = connection.execute(sql)
    columns = [d[0] for d in cursor.description]
    return sorted(columns), table(columns, cursor.fetchall())
