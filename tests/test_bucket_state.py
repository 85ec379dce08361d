"""States in buckets: only what changed is read and written."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from test_plans import plan

from clientlens.sources import bucket_state, commits
from clientlens.sources.workdir import shared_folder

DDL = "client BIGINT, division INT, name STRING"


@pytest.fixture
def where(spark):
    return f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def clients(n, **changed):
    return [(i, i % 3, changed.get(f"c{i}", f"name {i}")) for i in range(n)]


def test_one_changed_client_is_one_bucket(spark, frame, where):
    first = bucket_state.replace_buckets(frame(DDL, *clients(200)), where, ["client"], 16)
    assert first == list(range(16))
    later = frame(DDL, *clients(200, c77="other"))
    assert len(bucket_state.changed_buckets(later, where)) == 1
    before = commits.latest(spark, where)[1]["buckets"]
    (bucket,) = bucket_state.replace_buckets(later, where, ["client"], 16)
    after = commits.latest(spark, where)[1]["buckets"]
    assert [b for b in after if after[b] != before[b]] == [str(bucket)]
    assert rows(bucket_state.read_buckets(spark, where)) == rows(later)
    assert rows(bucket_state.read_buckets(spark, where, version=1)) == rows(frame(DDL, *clients(200)))
    part = bucket_state.read_buckets(spark, where, [bucket])
    assert f"_bucket={bucket}]" in plan(part) and part.count() < 40
    assert (77, 2, "other") in rows(part)
    assert rows(part) == rows(bucket_state.in_buckets(later, where, [bucket]))


def test_nothing_changed_writes_nothing(spark, frame, where):
    rows_now = clients(50)
    bucket_state.replace_buckets(frame(DDL, *rows_now), where, ["client"], 8)
    assert bucket_state.replace_buckets(frame(DDL, *reversed(rows_now)), where, ["client"], 8) == []
    assert commits.numbers(spark, where) == [1]


def test_repeated_rows_count(frame, where):
    """Rows that cancel each other out in a bitwise digest do not here."""
    bucket_state.replace_buckets(frame(DDL, (1, 1, "a"), (1, 1, "a"), (1, 1, "b")), where, ["client"], 4)
    assert bucket_state.changed_buckets(frame(DDL, (1, 1, "b"), (1, 1, "c"), (1, 1, "c")), where)
    assert bucket_state.changed_buckets(frame(DDL, (1, 1, "a"), (1, 1, "b")), where)


def test_only_the_columns_that_count(frame, where):
    bucket_state.replace_buckets(frame(DDL, *clients(30)), where, ["client"], 8, of=["client", "division"])
    assert bucket_state.changed_buckets(frame(DDL, *clients(30, c3="x")).drop("name"), where) == []
    assert len(bucket_state.changed_buckets(frame(DDL, *clients(29)), where)) == 1


def test_other_types_of_equal_numbers(frame, where):
    bucket_state.replace_buckets(frame(DDL, *clients(30)), where, ["client"], 8)
    wider = frame("client INT, division BIGINT, name STRING", *clients(30))
    assert bucket_state.changed_buckets(wider, where) == []
    assert sum(bucket_state.in_buckets(wider, where, [b]).count() for b in range(8)) == 30


def test_empty_states_and_other_bucketings(spark, frame, where):
    with pytest.raises(ValueError, match="no state"):
        bucket_state.read_buckets(spark, where)
    assert bucket_state.replace_buckets(frame(DDL), where, ["client"], 4) == []
    assert rows(bucket_state.read_buckets(spark, where)) == []
    bucket_state.replace_buckets(frame(DDL, *clients(9), (None, None, None)), where, ["client"], 4)
    bucket_state.replace_buckets(frame(DDL, *clients(9)), where, ["client", "division"], 7)
    assert rows(bucket_state.read_buckets(spark, where)) == rows(frame(DDL, *clients(9)))
    bucket_state.replace_buckets(frame(DDL), where, ["client", "division"], 7)
    assert rows(bucket_state.read_buckets(spark, where)) == []


def test_runs_at_once_leave_one_of_their_states(spark, frame, where):
    bucket_state.replace_buckets(frame(DDL, *clients(40)), where, ["client"], 8)
    states = [clients(40, c3=f"run {k}", **{f"c{10 + k}": "x"}) for k in range(3)]
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda s: bucket_state.replace_buckets(frame(DDL, *s), where, ["client"], 8), states))
    assert rows(bucket_state.read_buckets(spark, where)) in [rows(frame(DDL, *s)) for s in states]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 2), st.sampled_from("ab")), max_size=8), min_size=2, max_size=3))
def test_any_states(spark, steps):
    where = f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"
    for step in steps:
        df = spark.createDataFrame(step, DDL)
        changed = bucket_state.replace_buckets(df, where, ["client"], 4)
        assert rows(bucket_state.read_buckets(spark, where)) == rows(df)
        assert bucket_state.changed_buckets(df, where) == [] and set(changed) <= set(range(4))
