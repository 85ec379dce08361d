"""Rollups that are kept up to date, and tables in buckets."""

from __future__ import annotations

import uuid
from datetime import date

import pytest
from pyspark.sql import functions as F
from test_plans import plan

from clientlens.model import Slice
from clientlens.operators import conform, reports
from clientlens.plans.mapping import WINDOWS
from clientlens.sources import bucketed, commits, rollups, snapshots
from clientlens.sources.workdir import shared_folder

FLOOR = date(1995, 5, 17)  # inside a year


@pytest.fixture
def where(spark):
    return f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def activity(sample):
    return sample["client_activity"].select(*rollups.activity_rollup(FLOOR).keys, "enquiry_date", "job_date")


def written(df, path, **options):
    snapshots.write_snapshot(df, path, "enquiry_date", **options)


def same_as_full(kept, full, sample):
    w = WINDOWS.__class__(as_of=WINDOWS.as_of, floor=FLOOR)
    for part in (Slice(), Slice(division=3, subdivision=107), Slice(country=6, sector=2)):
        assert rows(conform.country_activity(kept, sample["country"], sample["region"], part)) == rows(
            conform.country_activity(full, sample["country"], sample["region"], part)
        )
        assert rows(conform.client_last(kept, w, part)) == rows(conform.client_last(full, w, part))
    assert rows(conform.last_activity_by_division(kept)) == rows(conform.last_activity_by_division(full))


def test_equal_to_the_full_aggregate_after_changes(spark, where, activity, sample):
    rollup = rollups.activity_rollup(FLOOR)
    written(activity, f"{where}/a")
    years = rollups.refresh(spark, f"{where}/a", f"{where}/r", rollup)
    assert len(years) >= 6
    same_as_full(rollups.read_rollup(spark, f"{where}/r"), activity, sample)
    assert rollups.read_rollup(spark, f"{where}/r").count() <= activity.count()
    # one year gets later jobs, one goes
    later = activity.withColumn("job_date", F.date_add("job_date", 500))
    written(later, f"{where}/a", years=[1995])
    written(activity.limit(0), f"{where}/a", years=[1993])
    assert rollups.refresh(spark, f"{where}/a", f"{where}/r", rollup) == ["1995"]
    now = snapshots.read_snapshot(spark, f"{where}/a").drop("enquiry_date_year")
    same_as_full(rollups.read_rollup(spark, f"{where}/r"), now, sample)
    assert rollups.refresh(spark, f"{where}/a", f"{where}/r", rollup) == []


def test_only_changed_years_are_read(spark, where, activity, monkeypatch):
    rollup = rollups.activity_rollup(FLOOR)
    written(activity, f"{where}/a")
    rollups.refresh(spark, f"{where}/a", f"{where}/r", rollup)
    written(activity, f"{where}/a", years=[1996])
    read, seen = snapshots.read_parts, []

    def noted(spark, path, parts, *rest):
        df = read(spark, path, parts, *rest)
        seen.append((sorted(parts), plan(df)))
        return df

    monkeypatch.setattr(snapshots, "read_parts", noted)
    before = commits.latest(spark, f"{where}/r")[1]["parts"]
    assert rollups.refresh(spark, f"{where}/a", f"{where}/r", rollup) == ["1996"]
    ((years, text),) = seen
    assert years == ["1996"] and "enquiry_date_year=1996" in text and "enquiry_date_year=1997" not in text
    after = commits.latest(spark, f"{where}/r")[1]["parts"]
    assert [y for y in after if after[y] != before[y]] == ["1996"]


def test_a_merge_makes_its_years_stale(spark, where, frame):
    ddl = "id BIGINT, client INT, day DATE"
    rollup = rollups.Rollup(("client",), ("day",), ("id",))
    table = frame(ddl, *[(i, i % 3, date(2000 + i % 4, 1 + i % 12, 1)) for i in range(40)], (99, 1, None))
    snapshots.write_snapshot(table, f"{where}/a", "day", key=["id"])
    assert rollups.refresh(spark, f"{where}/a", f"{where}/r", rollup) == ["2000", "2001", "2002", "2003", "__HIVE_DEFAULT_PARTITION__"]
    snapshots.merge_snapshot(frame(ddl, (1, 7, date(2003, 12, 31))), f"{where}/a")
    assert rollups.refresh(spark, f"{where}/a", f"{where}/r", rollup) == ["2001", "2003"]
    kept = rollups.read_rollup(spark, f"{where}/r").groupBy("client").agg(F.max("day"), F.min("id"))
    now = snapshots.read_snapshot(spark, f"{where}/a").groupBy("client").agg(F.max("day"), F.min("id"))
    assert rows(kept) == rows(now)


def test_another_rollup_starts_anew(spark, where, activity):
    written(activity, f"{where}/a")
    first = rollups.refresh(spark, f"{where}/a", f"{where}/r", rollups.activity_rollup(FLOOR))
    assert rollups.refresh(spark, f"{where}/a", f"{where}/r", rollups.activity_rollup(date(1996, 1, 1))) == first
    none = rollups.Rollup(("debtor_no",), ("enquiry_date",), where="debtor_no < 0")
    assert rollups.refresh(spark, f"{where}/a", f"{where}/none", none) == first
    assert rollups.refresh(spark, f"{where}/a", f"{where}/none", none) == []
    assert rows(rollups.read_rollup(spark, f"{where}/none")) == []
    with pytest.raises(ValueError, match="no years"):
        rollups.refresh(spark, f"{where}/a", f"{where}/x", rollups.Rollup(("debtor_no",), ("job_date",)))


# ---- buckets --------------------------------------------------------------------------------


@pytest.fixture
def bucketed_tables(spark, sample, where):
    bucketed.write_bucketed(sample["payment_allocation"], f"{where}/p", ["trans_no_to", "trans_type_to"], 4, "date_alloc")
    bucketed.write_bucketed(sample["invoice"], f"{where}/i", ["trans_no", "trans_type"], 4)
    found = {"payment_allocation": bucketed.read_bucketed(spark, f"{where}/p"), "invoice": bucketed.read_bucketed(spark, f"{where}/i")}
    return {**{n: sample[n] for n in ("client", "dimension")}, **found}


def test_buckets_meet_without_a_shuffle(spark, sample, bucketed_tables):
    month = date(2001, 6, 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(reports.monthly_revenue(bucketed_tables, month))
        plain = plan(reports.monthly_revenue(sample, month))
        drop = plan(reports.revenue_drop_from_payments(bucketed_tables, month))
        assert rows(reports.monthly_revenue(bucketed_tables, month)) == rows(reports.monthly_revenue(sample, month))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    on_invoices = lambda t: [x for x in t.split("\n") if "hashpartitioning(trans_no" in x]
    assert on_invoices(plain) and not on_invoices(text) and not on_invoices(drop)
    assert text.count("Bucketed: true") == 2
    assert any("date_alloc_year" in x for x in text.split("\n") if "PartitionFilters" in x)


def test_another_session_declares_the_buckets_itself(spark, sample, where):
    first = bucketed.write_bucketed(sample["invoice"], f"{where}/i", ["trans_no", "trans_type"], 4, "tran_date")
    second = bucketed.write_bucketed(sample["invoice"].limit(10), f"{where}/i", ["trans_no", "trans_type"], 4, "tran_date")
    for table in [x.name for x in spark.catalog.listTables() if x.name.startswith("clientlens_bucketed_")]:
        spark.sql(f"DROP TABLE {table}")  # the files stay: nothing but this session's catalog knows the table
    back = bucketed.read_bucketed(spark, f"{where}/i", version=first)
    columns = sample["invoice"].columns
    assert rows(back.select(*columns)) == rows(sample["invoice"])
    assert back.select("tran_date", "tran_date_year").where("year(tran_date) <> tran_date_year").count() == 0
    assert "Exchange hashpartitioning" not in plan(back.groupBy("trans_no", "trans_type").count())
    assert bucketed.read_bucketed(spark, f"{where}/i").count() == 10 and second == first + 1
    with pytest.raises(ValueError, match="no snapshot"):
        bucketed.read_bucketed(spark, f"{where}/nothing")
