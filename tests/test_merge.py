"""Changes merged into snapshots, and commits that several writers make at once."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from datetime import date

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientlens import schemas
from clientlens.sources import commits, snapshots, state
from clientlens.sources.workdir import shared_folder

DDL = "id BIGINT, day DATE, v STRING"


@pytest.fixture
def where(spark):
    return f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"


def rows(df):
    return sorted((tuple(r) for r in df.select("id", "day", "v").collect()), key=str)


def parts(spark, where):
    return commits.latest(spark, where)[1]["parts"]


def changes(frame, *listed):
    return frame(f"{DDL}, gone BOOLEAN", *listed)


def test_an_emptied_year_reads_back_empty(spark, frame, where):
    snapshots.write_snapshot(frame(DDL, (1, date(1997, 1, 1), "a"), (2, date(1998, 1, 1), "b")), where, "day")
    snapshots.write_snapshot(frame(DDL), where, "day", years=[1997])
    assert rows(snapshots.read_snapshot(spark, where)) == [(2, date(1998, 1, 1), "b")]
    declared = T.StructType.fromDDL(DDL)
    assert rows(snapshots.read_snapshot(spark, where, declared, "day")) == [(2, date(1998, 1, 1), "b")]
    snapshots.write_snapshot(frame(DDL), where, "day", years=[1998])
    assert rows(snapshots.read_snapshot(spark, where)) == []
    assert snapshots.read_snapshot(spark, where).columns == ["id", "day", "v", "day_year"]


def test_a_row_that_moved_counts_once(spark, frame, where):
    snapshots.write_snapshot(
        frame(DDL, (1, date(1997, 1, 1), "a"), (2, date(1997, 2, 1), "b"), (3, date(1999, 1, 1), "c")), where, "day", key=["id"]
    )
    moved = frame(DDL, (1, date(1998, 5, 1), "moved"))
    snapshots.write_snapshot(moved, where, "day", years=[1998], key=["id"])
    wanted = [(1, date(1998, 5, 1), "moved"), (2, date(1997, 2, 1), "b"), (3, date(1999, 1, 1), "c")]
    assert rows(snapshots.read_snapshot(spark, where)) == wanted
    # and back again by a merge
    snapshots.merge_snapshot(frame(DDL, (1, date(1997, 7, 1), "back")), where)
    assert rows(snapshots.read_snapshot(spark, where))[0] == (1, date(1997, 7, 1), "back")
    assert set(parts(spark, where)) == {"1997", "1999"}


def test_only_touched_years_are_written(spark, frame, where):
    snapshots.write_snapshot(frame(DDL, *[(i, date(1990 + i, 1, 1), "a") for i in range(6)]), where, "day", key=["id"])
    before = parts(spark, where)
    snapshots.merge_snapshot(changes(frame, (2, date(1994, 3, 3), "moved", False), (5, None, None, True)), where, deleted="gone")
    after = parts(spark, where)
    assert {y for y in before if after.get(y) != before[y]} == {"1992", "1994", "1995"}
    assert set(after) == {"1990", "1991", "1993", "1994"}
    assert (after["1994"]["rows"], after["1994"]["least"], after["1994"]["most"]) == (2, 2, 4)


def test_years_whose_keys_are_out_of_range_are_not_scanned(spark, frame, where, monkeypatch):
    snapshots.write_snapshot(frame(DDL, *[(i, date(1990 + i // 10, 1, 1), "a") for i in range(60)]), where, "day", key=["id"])
    asked = []
    read = snapshots.read_parts
    monkeypatch.setattr(snapshots, "read_parts", lambda s, p, parts, *a: asked.append(set(parts)) or read(s, p, parts, *a))
    snapshots.merge_snapshot(frame(DDL, (31, date(1993, 5, 5), "b"), (700, date(1993, 6, 6), "new")), where)
    assert asked == [{"1993"}, {"1993"}]


def test_rows_without_a_date_and_two_column_keys(spark, frame, where):
    ddl = "id BIGINT, kind INT, day DATE, v STRING"
    first = frame(ddl, (1, 1, None, "a"), (1, 2, date(2000, 1, 1), "b"), (None, 1, date(2000, 1, 1), "no key"))
    snapshots.write_snapshot(first, where, "day", key=["id", "kind"])
    snapshots.merge_snapshot(frame(ddl, (1, 1, date(2000, 2, 2), "dated"), (1, 2, None, "undated")), where)
    assert rows(snapshots.read_snapshot(spark, where)) == sorted(
        [(1, date(2000, 2, 2), "dated"), (1, None, "undated"), (None, date(2000, 1, 1), "no key")], key=str
    )


def test_tables_without_years(spark, frame, where):
    snapshots.write_snapshots({"region": frame("id INT, name STRING", (1, "a"), (2, "b"))}, where)
    snapshots.merge_snapshots({"region": frame("id INT, name STRING, gone BOOLEAN", (1, None, True), (3, "c", False))}, where, "gone")
    loaded = snapshots.load_tables(spark, where, ["region"], views=False)["region"]
    assert sorted(tuple(r) for r in loaded.collect()) == [(2, "b"), (3, "c")]


def test_keys_twice_or_null_are_refused(spark, frame, where):
    snapshots.write_snapshot(frame(DDL, (1, date(2000, 1, 1), "a")), where, "day", key=["id"])
    for bad in ([(7, None, "x"), (7, None, "y")], [(None, None, "x")]):
        with pytest.raises(ValueError, match="once and not be null"):
            snapshots.merge_snapshot(frame(DDL, *bad), where)
    assert commits.numbers(spark, where) == [1]
    snapshots.merge_snapshot(frame(DDL), where)  # nothing to do
    assert commits.numbers(spark, where) == [1]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    old=st.dictionaries(st.integers(0, 12), st.integers(0, 4)),
    steps=st.lists(st.dictionaries(st.integers(0, 15), st.one_of(st.none(), st.integers(0, 4)), max_size=6), max_size=2),
)
def test_merges_equal_a_dictionary(spark, old, steps):
    where, known = f"{shared_folder(spark)}/test-{uuid.uuid4().hex}", dict(old)
    day = lambda y: None if y is None or y == 4 else date(2000 + y, 1, 1)
    snapshots.write_snapshot(spark.createDataFrame([(k, day(y), str(y)) for k, y in old.items()], DDL), where, "day", key=["id"])
    for step in steps:
        listed = [(k, day(y), str(y), y is None) for k, y in step.items()]
        snapshots.merge_snapshot(spark.createDataFrame(listed, f"{DDL}, gone BOOLEAN"), where, deleted="gone")
        known = {k: y for k, y in {**known, **step}.items() if y is not None}
    assert rows(snapshots.read_snapshot(spark, where)) == sorted(((k, day(y), str(y)) for k, y in known.items()), key=str)


def test_merges_at_once_lose_nothing(spark, frame, where):
    snapshots.write_snapshot(frame(DDL, (0, date(2000, 1, 1), "a")), where, "day", key=["id"])
    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(lambda i: snapshots.merge_snapshot(frame(DDL, (i, date(2000 + i % 2, 1, 1), "b")), where), range(1, 5)))
    assert sorted(done) == [2, 3, 4, 5]
    assert [r[0] for r in rows(snapshots.read_snapshot(spark, where))] == [0, 1, 2, 3, 4]


def test_one_writer_gets_a_number(spark, where):
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda i: commits.try_commit(spark, where, 1, {"by": i}), range(8)))
    assert sum(got) == 1
    assert commits.record(spark, where, 1) == {"by": got.index(True)}
    assert not [n for n in commits.children(spark, f"{where}/_commits") if not n.endswith(".json")]


@pytest.mark.parametrize("move", ["_link", "_rename"])
def test_what_stands_is_not_replaced(move, spark, where, monkeypatch):
    """By a link as on this disk, and by a rename as on other file systems."""
    monkeypatch.setattr(commits, "_link", getattr(commits, move))
    assert commits.try_commit(spark, where, 1, {"by": "first"})
    assert not commits.try_commit(spark, where, 1, {"by": "second"})
    assert commits.try_commit(spark, where, 2, {"by": "second"})
    assert commits.record(spark, where, 1) == {"by": "first"} and commits.latest(spark, where) == (2, {"by": "second"})
    assert [n for n in commits.children(spark, f"{where}/_commits") if not n.endswith(".crc")] == ["000000001.json", "000000002.json"]


def test_two_writers_of_a_state_make_two_versions(spark, frame, where):
    with ThreadPoolExecutor(2) as pool:
        done = list(pool.map(lambda i: state.replace_state(frame("k INT", (i,)), where), (1, 2)))
    assert sorted(done) == state.versions(spark, where) == [1, 2]
    seen = [state.read_state(spark, where, "k INT", version=n).first()[0] for n in (1, 2)]
    assert sorted(seen) == [1, 2]


def test_a_killed_writer_makes_no_version(spark, frame, where):
    assert state.replace_state(frame("k INT", (1,)), where) == 1
    frame("k INT", (9,)).write.parquet(f"{where}/{commits.fresh('data')}")  # killed before its commit
    assert state.versions(spark, where) == [1]
    assert state.replace_state(frame("k INT", (2,)), where) == 2
    assert [r[0] for r in state.read_state(spark, where, "k INT").collect()] == [2]


def test_a_state_worked_out_from_an_old_version_is_refused(spark, frame, where):
    first = state.replace_state(frame("k INT", (1,)), where, based_on=0)
    state.replace_state(frame("k INT", (2,)), where)
    with pytest.raises(commits.Conflict):
        state.replace_state(frame("k INT", (3,)), where, based_on=first)
    assert [r[0] for r in state.read_state(spark, where, "k INT").collect()] == [2]
    assert state.update_state(spark, where, "k INT", lambda known: known.union(frame("k INT", (3,)))) == 3
    assert sorted(r[0] for r in state.read_state(spark, where, "k INT").collect()) == [2, 3]


def test_clean_up_keeps_what_readers_need(spark, frame, where):
    for i in range(4):
        state.replace_state(frame("k INT", (i,)), f"{where}/state")
    assert state.clean_up(spark, f"{where}/state", keep=2) == []  # all were written just now
    assert len(state.clean_up(spark, f"{where}/state", keep=2, idle_hours=0)) == 2
    assert [state.read_state(spark, f"{where}/state", "k INT", version=n).first()[0] for n in (3, 4)] == [2, 3]
    assert state.replace_state(frame("k INT", (9,)), f"{where}/state") == 5

    snapshots.write_snapshot(frame(DDL, (1, date(2000, 1, 1), "a"), (2, date(2001, 1, 1), "a")), f"{where}/table", "day", key=["id"])
    for v in "bcd":
        snapshots.merge_snapshot(frame(DDL, (1, date(2000, 1, 1), v)), f"{where}/table")
    kept = rows(snapshots.read_snapshot(spark, f"{where}/table"))
    assert len(snapshots.clean_up(spark, f"{where}/table", keep=1, idle_hours=0)) == 2  # the first write still holds 2001
    assert rows(snapshots.read_snapshot(spark, f"{where}/table")) == kept == [(1, date(2000, 1, 1), "d"), (2, date(2001, 1, 1), "a")]


def test_ranges_of_equal_depth(spark):
    """A dense stretch of keys, which ranges of equal width put into one of them."""
    known = spark.range(1000).select(F.when(F.col("id") < 990, F.col("id")).otherwise(F.col("id") * 1_000_000).alias("id"))
    ranges = snapshots.key_ranges("id", snapshots.equal_depth(known, "id", 8))
    source = known.union(spark.sql("SELECT CAST(NULL AS BIGINT) AS id UNION ALL SELECT -5L UNION ALL SELECT 9999999999L"))
    sizes = [source.where(r).count() for r in ranges]
    assert len(sizes) == 8 and sum(sizes) == 1003 and max(sizes) <= 135
    assert snapshots.key_ranges("id", []) == ["1 = 1"]
    assert snapshots.key_ranges("id", [5, 2.5]) == ["id < 2.5 OR id IS NULL", "id >= 2.5 AND id < 5", "id >= 5"]


def test_every_source_table_has_a_key():
    assert set(schemas.KEY) == set(schemas.SOURCE_TABLES)
    for name, key in schemas.KEY.items():
        assert all(f" {column} " in f" {schemas.DDL[name].replace(',', ' ').replace(chr(10), ' ')} " for column in key)
