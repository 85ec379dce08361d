"""What the physical plans must and must not contain."""

from __future__ import annotations

import re
from datetime import date

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from clientlens import schemas
from clientlens.operators import conform, listings
from clientlens.operators.numbering import numbered
from clientlens.plans.catalog import BUILDERS
from clientlens.plans.mapping import MAPPING, WINDOWS
from clientlens.sources import state

def plan(df, mode="formatted") -> str:
    spark = df.sparkSession
    kind = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    return df._jdf.queryExecution().explainString(kind)


def scanned(df) -> list[str]:
    """Snapshot names that the plan scans, one entry per scan."""
    return re.findall(r"Location: InMemoryFileIndex ?(?:\(\d+ paths\))?\[\S*?/(\w+)/rows/write=", plan(df))


@pytest.fixture
def no_broadcast(spark):
    """As on a cluster where no side is small enough."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", BUILDERS)
def test_no_cross_join_and_no_python(name, snapshots, no_broadcast, monkeypatch):
    """Neither in the result nor in what a query writes on the way."""
    written = []
    for method in ("parquet", "saveAsTable"):
        write = getattr(DataFrameWriter, method)
        noted = lambda self, *a, _write=write, **o: written.append(plan(self._df, "simple")) or _write(self, *a, **o)
        monkeypatch.setattr(DataFrameWriter, method, noted)
    result = plan(BUILDERS[name](snapshots), "simple")
    for text in (*written, result):
        assert not re.search("Cartesian|NestedLoop|Python|MapInPandas|ArrowEval", text)


def test_small_dimensions_are_broadcast_without_a_hint(snapshots):
    text = plan(BUILDERS["r21_high_value_enquiries"](snapshots), "simple")
    assert text.count("BroadcastHashJoin") >= 4


def test_windows_and_columns_reach_the_scan(snapshots):
    text = plan(BUILDERS["k7_enquiry_share_by_division"](snapshots))
    assert re.search(r"PartitionFilters: \[.*enquiry_date_year.*1999.*2001", text)
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(enquiry_date,1999-11-04\)", text)
    (columns,) = re.findall(r"ReadSchema: struct<(.*)>", text)
    names = re.findall(r"(\w+):", columns)
    assert sorted(names) == sorted(
        ["enquiry_date", "division", "enq_status", "aprox_amount", "rate", "client_type"]
    )


def test_slices_reach_the_scan(snapshots):
    text = plan(BUILDERS["c4_country_activity_sliced"](snapshots))
    assert re.search(r"PushedFilters: \[.*EqualTo\(division,3\).*EqualTo\(sub_division,107\)", text)


def test_a_listing_scans_each_fact_once(snapshots, no_broadcast):
    text = plan(BUILDERS["l3_client_listing"](snapshots), "simple")
    scans = scanned(BUILDERS["l3_client_listing"](snapshots))
    for fact in ("enquiry", "invoice", "client_activity"):
        assert scans.count(fact) == 1
    # activity, business and directory, each once
    assert text.count("Exchange hashpartitioning(client_ref") == 3


def test_the_board_scans_each_fact_once(snapshots, no_broadcast):
    scans = scanned(BUILDERS["k13_kpi_metrics"](snapshots))
    assert scans.count("enquiry") == scans.count("invoice") == 1
    assert scans.count("activity_code_activity") == 1
    assert scans.count("client_activity") == 2  # by country and by client


def test_top_n_is_no_full_sort(snapshots):
    text = plan(BUILDERS["t1_top_clients_by_enquiry"](snapshots), "simple")
    assert "TakeOrderedAndProject" in text
    assert "rangepartitioning" not in text


def _skewed(spark, rows=60_000):
    """A third of all enquiries from one client, a third without any client."""
    i = F.col("id")
    return spark.range(0, rows, 1, 8).select(
        i.alias("client_enquiry_id"),
        F.when(i % 3 == 0, 7).when(i % 3 == 1, 0).otherwise(i % 500 + 1).alias("debtor_no"),
        F.lit(0).alias("enquiry_temp_id"),
        F.lit(date(2001, 6, 1)).alias("enquiry_date"),
        (i % 5).cast("int").alias("enq_status"),
        F.lit(3).alias("division"),
        F.lit(107).alias("subdivision"),
        F.concat(F.lit("B"), i).alias("book_no"),
        F.lit(100).cast("decimal(18,4)").alias("aprox_amount"),
        F.lit(1).cast("decimal(12,6)").alias("rate"),
    )


def _clients(spark):
    i = F.col("id")
    return spark.range(1, 600).select(
        i.alias("debtor_no"), F.concat(F.lit("c"), i).alias("name"), F.lit(1).alias("country"),
        F.lit(1).alias("client_type"), F.lit(1).alias("client_status"),
    )


@pytest.fixture
def small_partitions(spark, no_broadcast):
    """AQE takes partitions of this test's size for skewed."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_hot_client_is_split_in_row_level_views(spark, sample, small_partitions):
    """AQE splits the partition of the hot client and of the rows without client."""
    view = conform.resolve_client(_skewed(spark), _clients(spark), sample["temp_client"])
    found = view.groupBy(F.col("client_name").isNull().alias("unknown")).count()
    assert {r["unknown"]: r["count"] for r in found.collect()} == {True: 20_000, False: 40_000}
    view.write.format("noop").mode("overwrite").save()
    assert len(view.collect()) == 60_000
    assert "skew=true" in plan(view, "simple")


def test_a_hot_client_is_split_in_the_sample_mapping(spark, sample, small_partitions):
    inputs = {"enquiry_facts": _skewed(spark), "client": _clients(spark), "temp_client": sample["temp_client"]}
    enquiries = spark.sql(MAPPING["enquiry"], **inputs)
    assert len(enquiries.collect()) == 60_000
    assert "skew=true" in plan(enquiries, "simple")
    assert enquiries.filter("client_type IS NULL").count() == 20_000


def test_a_hot_client_enters_no_join_of_a_listing(spark, sample, no_broadcast):
    """The business of a client is reduced map-side: at most one row per task and client."""
    tables = dict(sample.items())
    for name in ("invoice", "temp_client", "country", "region", "client_type"):
        tables[name] = sample[name]
    tables.update(enquiry=_skewed(spark), client=_clients(spark))
    rollup = listings.enquiry_status_rollup(tables, "client").filter("client_ref = 7").first()
    assert rollup["total_enquiry_count"] == 20_000 + 40
    assert rollup["total_enquiry_amount"] == (20_000 + 40) * 100.0
    text = plan(listings.enquiry_status_rollup(tables, "client"), "simple")
    partial = text.index("partial_")
    assert text.index("Exchange hashpartitioning(client_ref") < partial  # printed top-down
    assert WINDOWS


def test_running_numbers_move_the_rows_once(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 3).alias("section"))
    text = plan(numbered(rows, [F.col("id")], ["section"]), "simple")
    # what is left after the rows were written: no exchange of rows, only of the few offsets
    assert not re.search("Exchange (hash|range)partitioning|SortMergeJoin|Window", text)


def test_tracking_is_one_aggregate(spark, snapshots, no_broadcast):
    tracked = spark.createDataFrame([], schemas.schema("inactive_tracking"))
    keys = tracked.select("debtor_no", "division_id")
    text = plan(state.update_tracking(tracked.unionByName(tracked), keys, tracked.drop("logged_at")), "simple")
    assert "Join" not in text
    assert text.count("Exchange") <= 1


def test_tracking_query_has_few_joins(snapshots, no_broadcast):
    text = plan(BUILDERS["s7_update_tracking"](snapshots), "simple")
    assert text.count("SortMergeJoin") <= 9


def test_enquiries_meet_their_clients_once(sample, no_broadcast):
    """On a key of its own for every client: temporary clients do not share the number 0."""
    text = plan(sample["enquiry"], "simple")
    assert text.count("SortMergeJoin") == 1 and text.count("LeftOuter") == 1
