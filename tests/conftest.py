from __future__ import annotations

import os
import sys
import uuid

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from compare import SAMPLE  # noqa: E402

from clientlens.plans.mapping import SampleTables, SnapshotTables, extract  # noqa: E402
from clientlens.session import local_session  # noqa: E402
from clientlens.sources.workdir import shared_folder  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sample(spark):
    return SampleTables(spark, SAMPLE)


@pytest.fixture(scope="session")
def snapshots(spark):
    folder = f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"
    extract(spark, SAMPLE, folder)
    return SnapshotTables(spark, SAMPLE, folder)


@pytest.fixture
def frame(spark):
    """Small typed frame from a DDL schema and rows."""

    def make(ddl: str, *rows: tuple):
        return spark.createDataFrame(list(rows), ddl)

    return make
