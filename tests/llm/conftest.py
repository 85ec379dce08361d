from __future__ import annotations

import uuid

import pytest

from awkward_rows import AWKWARD, COLUMNS

from clientlens.sources.workdir import shared_folder

@pytest.fixture(scope="session")
def table(spark):
    """A table read from files, as operators that read twice need it; `extra` adds columns with names of their own."""

    def make(ddl: str, rows: list[tuple], extra: tuple[str, ...] = ()):
        path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        df = spark.createDataFrame(rows, ddl)
        for name in extra:
            df = df.selectExpr("*", f"cast(7 as long) as `{name}`")
        df.repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return make


@pytest.fixture(scope="session")
def awkward(table):
    names = ("row", "part", "place", "mark", "n", "set", "kept", "score", "key", "cut", "epochs", "tokens", "bucket", "license", "id", "a.b")
    return table(COLUMNS, AWKWARD, names)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
