from __future__ import annotations

import uuid
from datetime import date, datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from clientlens import schemas
from clientlens.operators import listings, reports
from clientlens.operators.slices import between_dates
from clientlens.plans.mapping import AS_OF, WINDOWS
from clientlens.sources import snapshots, state
from clientlens.sources.workdir import shared_folder


def folder(spark) -> str:
    return f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_every_declared_schema_parses(spark):
    assert len(schemas.SOURCE_TABLES) == 18
    for name in schemas.DDL:
        assert schemas.schema(name).fieldNames()
    assert len(schemas.schema("enquiry")) == 74
    assert len(schemas.schema("dimension")) == 55


def test_extract_types_filters_and_cleans(frame):
    source = frame(
        "debtor_no STRING, name STRING, added_date STRING, inactive INT",
        ("1", "a", "2024-01-01", 0), ("x", "b", "0000-00-00", 0), ("3", "c", "2024-01-01", 1),
    )
    schema = schemas.schema("client")
    wanted = type(schema)([schema[n] for n in ("debtor_no", "name", "added_date")])
    out = snapshots.extract(source, wanted, "inactive = 0")
    assert out.schema.simpleString() == "struct<debtor_no:bigint,name:string,added_date:date>"
    assert [tuple(r) for r in out.collect()] == [(1, "a", date(2024, 1, 1)), (None, "b", None)]


def test_extract_of_a_whole_table_with_floor(frame):
    ddl = ", ".join(f"{f.name} STRING" for f in schemas.schema("credit_note"))
    row = {"trans_no": "1", "ov_amount": "10.5", "tran_date": "2024-05-01", "rate": "1.25"}
    names = schemas.schema("credit_note").fieldNames()
    source = frame(ddl, tuple(row.get(n) for n in names), tuple(None for _ in names))
    out = snapshots.extract_table(source, "credit_note", date(2024, 1, 1))
    assert out.schema.fieldNames() == names
    (only,) = out.collect()
    assert (only["trans_no"], float(only["ov_amount"]), only["tran_date"]) == (1, 10.5, date(2024, 5, 1))


def test_snapshots_round_trip_with_views(spark, frame):
    where = folder(spark)
    region = frame("id INT, name STRING", (1, "a"), (2, "b"))
    snapshots.write_snapshots({"region": region}, where)
    tables = snapshots.load_tables(spark, where, ["region"])
    assert rows(tables["region"]) == rows(spark.table("region")) == [(1, "a"), (2, "b")]


def test_year_folders_are_pruned_and_nothing_is_lost(spark, sample):
    where = folder(spark)
    invoices = sample["invoice"].select("trans_no", "tran_date")
    snapshots.write_snapshot(invoices, where, "tran_date")
    stored = snapshots.read_snapshot(spark, where, year_of="tran_date")
    assert rows(stored.select("trans_no", "tran_date")) == rows(invoices)
    window = between_dates(stored, "tran_date", date(1999, 3, 1), date(2000, 2, 1))
    plan = window._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "tran_date_year" in plan.split("PartitionFilters")[1].split("\n")[0]
    expected = invoices.filter(F.col("tran_date").between(date(1999, 3, 1), date(2000, 2, 1)))
    assert rows(window.select("trans_no", "tran_date")) == rows(expected)


def test_year_folders_load_with_the_declared_schema(spark, frame):
    where = folder(spark)
    names = schemas.schema("payment_allocation").fieldNames()
    source = frame(
        ", ".join(f"{n} STRING" for n in names),
        *[tuple({"id": str(i), "date_alloc": f"{2000 + i}-05-01"}.get(n) for n in names) for i in range(4)],
    )
    extracted = snapshots.extract_table(source, "payment_allocation")
    snapshots.write_snapshots({"payment_allocation": extracted}, where)
    loaded = snapshots.load_tables(spark, where, ["payment_allocation"])["payment_allocation"]
    assert loaded.select(*names).schema == schemas.schema("payment_allocation")
    recent = between_dates(loaded, "date_alloc", date(2002, 1, 1))
    assert rows(recent.select("id", "date_alloc_year")) == [(2, 2002), (3, 2003)]


def test_state_starts_empty_or_seeded(spark, frame):
    where, ddl = folder(spark), "k INT, v STRING"
    assert rows(state.read_state(spark, where, ddl)) == []
    seed = frame(ddl, (1, "seed"))
    assert rows(state.read_state(spark, where, ddl, seed)) == [(1, "seed")]


def test_state_keeps_the_latest_complete_version(spark, frame):
    where, ddl = folder(spark), "k INT, v STRING"
    assert state.replace_state(frame(ddl, (1, "old")), where) == 1
    # a new version may be computed from the one it replaces
    current = state.read_state(spark, where, ddl)
    assert state.replace_state(current.withColumn("v", F.lit("new")), where) == 2
    assert rows(state.read_state(spark, where, ddl)) == [(1, "new")]
    # a version without its success marker is a run that failed: ignored, then replaced
    frame(ddl, (9, "broken")).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(
        f"{where}/v000003"
    )
    assert state.versions(spark, where) == [1, 2]
    assert rows(state.read_state(spark, where, ddl)) == [(1, "new")]
    assert state.replace_state(frame(ddl, (2, "next")), where) == 3
    assert rows(state.read_state(spark, where, ddl)) == [(2, "next")]


def test_tracking_drops_recovered_and_adds_new(frame):
    ddl = "debtor_no BIGINT, division_id INT, last_job_date DATE"
    old, new = date(2022, 1, 1), date(2023, 1, 1)
    tracked = frame(ddl, (1, 3, old), (2, 3, old), (3, 3, old))
    recovered = frame("debtor_no BIGINT, division_id INT", (2, 3))
    current = frame(ddl, (1, 3, new), (4, 3, new), (4, 225, new), (4, 3, old))
    once = state.update_tracking(tracked, recovered, current)
    assert rows(once) == [(1, 3, old), (3, 3, old), (4, 3, new), (4, 225, new)]
    nothing = recovered.limit(0)
    assert rows(state.update_tracking(once, nothing, current)) == rows(once)


# ---- the extract on what sources really hold ----------------------------------------------


@pytest.mark.parametrize("text", ["0000-00-00", "junk", "", None])
def test_floor_on_text_dates_drops_junk(frame, text):
    names = schemas.schema("credit_note").fieldNames()
    ddl = ", ".join(f"{n} STRING" for n in names)
    rows_of = [{"trans_no": "1", "tran_date": "2024-05-01"}, {"trans_no": "2", "tran_date": text}]
    source = frame(ddl, *[tuple(r.get(n) for n in names) for r in rows_of])
    assert [r["trans_no"] for r in snapshots.extract_table(source, "credit_note", date(2024, 1, 1)).collect()] == [1]
    everything = snapshots.extract_table(source, "credit_note").orderBy("trans_no").collect()
    assert [r["tran_date"] for r in everything] == [date(2024, 5, 1), None]


def test_floor_on_dates_is_pushed_down(spark, sample):
    path = folder(spark)
    sample["invoice"].write.parquet(path)
    kept = snapshots.extract(
        spark.read.parquet(path), spark.read.parquet(path).schema, None, "tran_date", date(2000, 1, 1)
    )
    plan = kept._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(tran_date" in plan


def test_days_of_timestamps(frame):
    source = frame(
        "debtor_no BIGINT, added_date TIMESTAMP, inactive INT", (1, datetime(2024, 5, 1, 10, 11), 0), (2, datetime(2024, 5, 2), 0)
    )
    wanted = schemas.schema("client")
    wanted = type(wanted)([wanted[n] for n in ("debtor_no", "added_date")])
    strict = snapshots.extract(source, wanted)
    assert rows(strict) == [(1, None), (2, date(2024, 5, 2))]
    kept = snapshots.extract(source, wanted, keep_day=schemas.KEEP_DAY["client"])
    assert rows(kept) == [(1, date(2024, 5, 1)), (2, date(2024, 5, 2))]
    text = source.withColumn("added_date", F.col("added_date").cast("string"))
    assert rows(snapshots.extract(text, wanted, keep_day=("added_date",))) == rows(kept)


def test_source_names(frame):
    names = [schemas.SOURCE_NAME["invoice"].get(n, n) for n in schemas.schema("invoice").fieldNames()]
    source = frame(", ".join(f"{n} STRING" for n in names), tuple({"type": "10", "trans_no": "5"}.get(n) for n in names))
    (only,) = snapshots.extract_table(source, "invoice").collect()
    assert (only["trans_no"], only["trans_type"]) == (5, 10)


def test_snapshot_versions(spark, frame):
    where, ddl = folder(spark), "id INT, day DATE"
    old = frame(ddl, *[(i, date(2000 + i, 1, 1)) for i in range(4)], (9, None))
    snapshots.write_snapshot(old, where, "day")
    # a write that fails half way changes nothing
    old.limit(1).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{where}/v000002")
    assert rows(snapshots.read_snapshot(spark, where, year_of="day").select("id")) == [(0,), (1,), (2,), (3,), (9,)]
    # new rows of two years, of which one has none any more
    snapshots.write_snapshot(frame(ddl, (20, date(2002, 5, 5)), (30, date(1990, 1, 1))), where, "day", years=[2002, 2003])
    assert rows(snapshots.read_snapshot(spark, where, year_of="day").select("id")) == [(0,), (1,), (9,), (20,)]
    snapshots.write_snapshot(frame(ddl, (21, date(2002, 6, 6))), where, "day", years=[2002])
    declared = type(old.schema).fromDDL(ddl)
    assert rows(snapshots.read_snapshot(spark, where, declared, "day").select("id")) == [(0,), (1,), (9,), (21,)]
    # a whole version replaces all of it
    snapshots.write_snapshot(frame(ddl, (5, date(2002, 1, 1))), where, "day")
    assert rows(snapshots.read_snapshot(spark, where, year_of="day").select("id")) == [(5,)]


def test_tracking_fits_its_own_table(spark, frame):
    where, declared = folder(spark), schemas.schema("inactive_tracking")
    then, now = datetime(2023, 1, 1), datetime(2024, 1, 1)
    state.replace_state(spark.createDataFrame([(1, 3, date(2022, 1, 1), then), (2, 3, date(2022, 1, 1), then)], declared), where)
    tracked = state.read_state(spark, where, declared)
    keys = "debtor_no BIGINT, division_id INT"
    current = frame(f"{keys}, last_job_date DATE", (1, 3, date(2023, 1, 1)), (4, 3, date(2023, 1, 1)))
    updated = state.update_tracking(tracked, frame(keys, (2, 3)), current, F.lit(now))
    assert updated.columns == declared.fieldNames()
    state.replace_state(updated, where)
    assert rows(state.read_state(spark, where, declared)) == [
        (1, 3, date(2022, 1, 1), then), (4, 3, date(2023, 1, 1), now),
    ]


@pytest.mark.parametrize("name", schemas.STATE_TABLES)
def test_states_round_trip_in_declared_columns(spark, sample, name):
    made = {
        "monthly_revenue": lambda: reports.monthly_revenue(sample, date(2001, 7, 1)),
        "idle_clients_tracking": lambda: listings.idle_snapshot_all_divisions(sample, WINDOWS, (225, 3)),
        "inactive_tracking": lambda: reports.inactive_clients(sample, AS_OF).select(
            "debtor_no", "division_id", "last_job_date", F.lit(datetime(2024, 1, 1)).alias("logged_at")
        ),
    }[name]()
    where, declared = folder(spark), schemas.schema(name)
    state.replace_state(made, where)
    assert set(made.columns) == set(declared.fieldNames())
    assert rows(state.read_state(spark, where, declared)) == rows(made.select(*declared.fieldNames()))


# ---- the shared folder --------------------------------------------------------------------


class FakeSession:
    def __init__(self, master: str, named: str | None):
        self.sparkContext = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        self.conf = SimpleNamespace(get=lambda key, default: named or default)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://host", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError):
        shared_folder(FakeSession(master, None))
    assert shared_folder(FakeSession(master, "hdfs://x/y/")) == "hdfs://x/y"


def test_a_local_session_is_not_changed():
    session = FakeSession("local[2]", None)
    assert shared_folder(session) == shared_folder(session)
    assert session.sparkContext.getCheckpointDir() is None


def test_rows_per_file_bound_the_files_of_a_snapshot(spark):
    """A task that reads whole files holds no more rows than they have, however well they shrink."""
    path = folder(spark)
    snapshots.write_snapshot(spark.range(35, numPartitions=1), path, rows_per_file=10)
    stored = snapshots.read_snapshot(spark, path)
    per_file = [r["count"] for r in stored.groupBy(F.input_file_name()).count().collect()]
    assert sorted(per_file) == [5, 10, 10, 10] and rows(stored) == [(i,) for i in range(35)]
