"""One runnable query per operator, over the whole sample tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientlens import schemas
from clientlens.functions import compact_amount, report_money, safe_divide, safe_percent
from clientlens.model import DIVISION_NAMES, GCC_COUNTRIES, NO_SLICE, OTHER_GROUP, Slice, Windows
from clientlens.operators import bitmaps, clean, conform, kpis, listings, rankings, reports, slices
from clientlens.operators.numbering import numbered
from clientlens.plans.board import kpi_metrics, whole_board
from clientlens.plans.mapping import AS_OF, FLOOR, WINDOWS, SampleTables
from clientlens.plans.sliced_boards import sliced_boards
from clientlens.sources import bucket_state, bucketed, rollups, snapshots, state
from clientlens.sources.workdir import shared_folder

Query = Callable[[SparkSession, str], DataFrame]

SLICE = Slice(division=3, subdivision=107)
DIVISION = Slice(division=3)
PLACE = Slice(country=6, sector=2)
REGION = Slice(region=2)
THIS_MONTH, LAST_MONTH = date(2001, 7, 1), date(2001, 6, 1)
SERIES = (date(2001, 7, 18), date(2001, 8, 1))
LOSSES = (date(2001, 1, 1), date(2001, 8, 1))
WEEK_DAY = date(2001, 7, 20)
STATE_DAY = date(2000, 11, 4)
LOGGED_AT = "2001-11-04 06:00:00"
CHANGED_YEAR = 1996
BUCKETS = 8
FLOOR_DAY = date(1900, 1, 1)
JOB_WINDOWS = Windows(as_of=AS_OF, floor=WINDOWS.floor, job_day=date(2000, 6, 30), job_months=6)
GROUPS = (*DIVISION_NAMES.values(), OTHER_GROUP)
W = WINDOWS

# Queries over given logical tables, and over the logical tables of a sample directory.
BUILDERS: dict[str, Callable[[SampleTables], DataFrame]] = {}
CATALOG: dict[str, Query] = {}


def query(name: str):
    """Register a query; it gets the logical tables."""

    def register(build: Callable[[SampleTables], DataFrame]) -> Callable:
        BUILDERS[name] = build
        CATALOG[name] = lambda spark, directory: build(SampleTables(spark, directory))
        return build

    return register


def _run_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/clientlens/{uuid.uuid4().hex}"


# ---- sources, cleaning, state -----------------------------------------------------------


@query("s1_extract_client")
def _(t):
    kept = T.StructType(
        [
            T.StructField("debtor_no", T.LongType()),
            T.StructField("name", T.StringType()),
            T.StructField("country", T.IntegerType()),
            T.StructField("client_type", T.IntegerType()),
            T.StructField("client_status", T.IntegerType()),
        ]
    )
    return snapshots.extract(t["client"], kept, "inactive = 0")


@query("s1_extract_enquiry")
def _(t):
    kept = T.StructType(
        [
            T.StructField("client_enquiry_id", T.LongType()),
            T.StructField("enquiry_date", T.DateType()),
            T.StructField("division", T.IntegerType()),
            T.StructField("enq_status", T.IntegerType()),
            T.StructField("book_no", T.StringType()),
        ]
    )
    return snapshots.extract(t["enquiry_facts"], kept, None, "enquiry_date", W.inactive_from)


@query("s1_write_snapshot")
def _(t):
    """Invoices written by year and read back through a date window."""
    folder = f"{_run_folder(t.spark)}/invoice"
    kept = ["trans_no", "debtor_no", "tran_date", "dimension2_id"]
    snapshots.write_snapshot(t["invoice"].select(*kept), folder, "tran_date")
    stored = snapshots.read_snapshot(t.spark, folder, year_of="tran_date")
    return slices.between_dates(stored, "tran_date", W.active_from, W.active_to).select(*kept)


@query("s1_changed_years")
def _(t):
    """Invoices of all years, and then one year written again with new amounts."""
    folder = f"{_run_folder(t.spark)}/invoice"
    rows = t["invoice"].select("trans_no", "tran_date", "ov_amount")
    snapshots.write_snapshot(rows, folder, "tran_date")
    doubled = rows.withColumn("ov_amount", (F.col("ov_amount") * 2).cast("decimal(18,4)"))
    snapshots.write_snapshot(doubled, folder, "tran_date", years=[CHANGED_YEAR])
    return (
        snapshots.read_snapshot(t.spark, folder, year_of="tran_date")
        .groupBy(F.year("tran_date").alias("year"))
        .agg(F.count("*").alias("invoices"), report_money(F.sum("ov_amount")).alias("amount"))
    )


@query("s1_merge_by_key")
def _(t):
    """Invoices, into which changes are merged by key: a year that goes, rows that move to other years, changed and new rows."""
    folder, number, year = f"{_run_folder(t.spark)}/invoice", F.col("trans_no"), F.year("tran_date")
    rows = t["invoice"].select("trans_no", "trans_type", "tran_date", "ov_amount")
    snapshots.write_snapshot(rows, folder, "tran_date", key=schemas.KEY["invoice"])
    gone = year == CHANGED_YEAR
    moved = (number % 50 == 0) & ~gone & (year != CHANGED_YEAR - 1)
    changes = rows.filter(gone | moved | (number % 50 == 1)).withColumns(
        {
            "tran_date": F.when(moved, F.add_months("tran_date", 12)).otherwise(F.col("tran_date")),
            "ov_amount": (F.col("ov_amount") * 2).cast("decimal(18,4)"),
            "deleted": gone,
        }
    )
    new = rows.filter((number % 50 == 2) & ~gone).withColumns({"trans_type": F.lit(11), "deleted": F.lit(False)})
    snapshots.merge_snapshot(changes.unionByName(new), folder, deleted="deleted")
    return (
        snapshots.read_snapshot(t.spark, folder)
        .groupBy(F.col("tran_date_year").alias("year"), "trans_type")
        .agg(
            F.count("*").alias("invoices"),
            F.count_distinct("trans_no").alias("numbers"),
            report_money(F.sum("ov_amount")).alias("amount"),
        )
    )


def _source_form(df: DataFrame, table: str) -> DataFrame:
    """A logical table as its source would give it: its names, texts, times of day and junk dates."""
    names = schemas.schema(table).fieldNames()
    df = df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast("string").alias(n) for n in names])
    for name, source in schemas.SOURCE_NAME.get(table, {}).items():
        df = df.withColumnRenamed(name, source)
    for name in schemas.KEEP_DAY.get(table, ()):
        df = df.withColumn(name, F.lit("2001-02-03 10:11:12").cast("timestamp"))
    floor = schemas.FLOOR_COLUMN.get(table)
    if floor is not None:
        junk = F.when(F.substring(floor, 10, 1) < "5", F.lit("0000-00-00")).otherwise(F.lit("junk"))
        df = df.unionByName(df.withColumn(floor, junk))
    return df.withColumns({"inactive": F.lit(0), "active": F.lit(1)})


@query("s1_extract_declared")
def _(t):
    """The whole chain: source form, declared extract, snapshots, declared load, country listing.

    The junk rows are added to try the extract; none of them is on or after the floor.
    """
    folder = _run_folder(t.spark)
    wanted = ("client", "temp_client", "country", "region", "client_type", "enquiry", "invoice", "client_activity")
    extracted = {n: snapshots.extract_table(_source_form(t[n], n), n, FLOOR_DAY) for n in wanted}
    snapshots.write_snapshots(extracted, folder)
    loaded = snapshots.load_tables(t.spark, folder, wanted, views=False)
    return listings.country_listing(loaded, W)


@query("s1_extract_all_tables")
def _(t):
    """All 18 source tables through the declared extract, snapshots and load: rows, sum of keys, days and texts of each."""
    folder = _run_folder(t.spark)
    extracted = {n: snapshots.extract_table(_source_form(t[n], n), n, FLOOR_DAY) for n in schemas.SOURCE_TABLES}
    snapshots.write_snapshots(extracted, folder)
    loaded = snapshots.load_tables(t.spark, folder, views=False)
    day = {**schemas.YEAR_OF, "sales_order": "ord_date", "client_activity": "enquiry_date"}
    shown = []
    for name, df in loaded.items():
        days = F.col(day[name]) if name in day else F.lit(None).cast("date")
        shown.append(
            df.agg(
                F.lit(name).alias("table_name"),
                F.count("*").alias("rows"),
                F.coalesce(F.sum(F.col(schemas.KEY[name][0]).cast("bigint")), F.lit(0)).alias("key_sum"),
                F.min(days).alias("first_day"),
                F.max(days).alias("last_day"),
            )
        )
    return reduce(DataFrame.unionByName, shown)


@query("s2_normalize_dates")
def _(t):
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    text = (
        F.when(key % 7 == 0, "0000-00-00")
        .when(key % 7 == 1, F.concat(day, F.lit(" 10:00:00")))
        .when(key % 7 == 2, "None")
        .when(key % 7 == 3, F.lit(None).cast("string"))
        .otherwise(day)
    )
    raw = t.source("orders").select(
        key.alias("order_no"), text.alias("order_date"), F.col("o_orderdate").alias("added_date")
    )
    return clean.normalize_dates(raw)


@query("s3_coerce_numeric")
def _(t):
    key, value = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    text = (
        F.when(key % 5 == 0, "")
        .when(key % 5 == 1, "abc")
        .when(key % 5 == 2, F.lit(None).cast("string"))
        .otherwise(value)
    )
    raw = t.source("orders").select(key.alias("order_no"), text.alias("amount"))
    return clean.coerce_numeric(raw, ["amount"])


@query("s4_normalize_key")
def _(t):
    key = F.col("c_custkey")
    text = (
        F.when(key % 3 == 0, F.concat(F.lit("  "), key.cast("string"), F.lit(" ")))
        .when(key % 3 == 1, "nan")
        .otherwise(key.cast("string"))
    )
    raw = t.source("customer").select(key.alias("c_custkey"), text.alias("debtor_no"))
    return clean.normalize_key(raw, "debtor_no")


@query("s5_load_tables")
def _(t):
    snapshots.load_tables(
        t.spark, t.directory, ("customer", "nation", "region"), suffix=".parquet", declared=False,
        prefix="s5_",
    )
    return t.spark.sql(
        """
        SELECT r_name, count(*) AS customers FROM s5_customer
        JOIN s5_nation ON c_nationkey = n_nationkey JOIN s5_region ON n_regionkey = r_regionkey
        GROUP BY r_name
        """
    )


@query("s6_state_round_trip")
def _(t):
    """Two versions of the revenue state; the second one is what the next run reads."""
    folder = f"{_run_folder(t.spark)}/monthly_revenue"
    state.replace_state(reports.monthly_revenue(t, LAST_MONTH), folder)
    state.replace_state(reports.monthly_revenue(t, THIS_MONTH), folder)
    return state.read_state(t.spark, folder, schemas.schema("monthly_revenue"))


@query("s6_idle_state_round_trip")
def _(t):
    """The idle listing as the next run reads it, in its declared columns."""
    folder = f"{_run_folder(t.spark)}/idle_clients_tracking"
    state.replace_state(listings.idle_snapshot_all_divisions(t, W, tuple(DIVISION_NAMES)), folder)
    return state.read_state(t.spark, folder, schemas.schema("idle_clients_tracking"))


@query("s6_two_writers")
def _(t):
    """Three runs at once, each of which adds a division's clients to one state: none is lost."""
    folder, declared = f"{_run_folder(t.spark)}/inactive_tracking", schemas.schema("inactive_tracking")
    logged = F.lit(f"{STATE_DAY} 06:00:00").cast("timestamp")
    tracked = _tracked(t).withColumn("logged_at", logged).select(*declared.fieldNames())

    def add(division: int) -> int:
        own = tracked.filter(F.col("division_id") == division)
        return state.update_state(t.spark, folder, declared, lambda known: known.unionByName(own))

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(add, (225, 3, 10)))
    return state.read_state(t.spark, folder, declared)


def _a_year_ago(t, day: str) -> SampleTables:
    """The tables with the activity that was known on an earlier day."""
    before = SampleTables(t.spark, t.directory)
    activity = t["client_activity"]
    before.update(t)
    before["client_activity"] = activity.filter(F.col(day) <= F.lit(STATE_DAY))
    return before


def _tracked(t) -> DataFrame:
    """What a run one year earlier has left behind."""
    return reports.inactive_clients(_a_year_ago(t, "job_date"), STATE_DAY).select(
        "debtor_no", "division_id", "last_job_date"
    )


def _recovered(t) -> DataFrame:
    return reports.recovered_clients(_tracked(t), t, AS_OF)


def _tracking_state(t) -> DataFrame:
    """The tracking table of a year ago, read from its state folder."""
    folder = f"{_run_folder(t.spark)}/inactive_tracking"
    logged = F.lit(f"{STATE_DAY} 06:00:00").cast("timestamp")
    state.replace_state(_tracked(t).withColumn("logged_at", logged), folder)
    return state.read_state(t.spark, folder, schemas.schema("inactive_tracking"))


@query("s7_update_tracking")
def _(t):
    tracked = _tracking_state(t)
    current = reports.inactive_clients(t, AS_OF).select("debtor_no", "division_id", "last_job_date")
    recovered = reports.recovered_clients(tracked, t, AS_OF)
    return state.update_tracking(tracked, recovered, current, F.lit(LOGGED_AT).cast("timestamp"))


@query("s7_update_tracking_by_buckets")
def _(t):
    """S7 on a state in buckets, of which only those with recovered or new clients are written again."""
    path, key = f"{_run_folder(t.spark)}/inactive_tracking", ["debtor_no", "division_id"]
    logged = F.lit(f"{STATE_DAY} 06:00:00").cast("timestamp")
    bucket_state.replace_buckets(_tracked(t).withColumn("logged_at", logged), path, key)
    tracked = bucket_state.read_buckets(t.spark, path)
    current = reports.inactive_clients(t, AS_OF).select("debtor_no", "division_id", "last_job_date")
    recovered = reports.recovered_clients(tracked, t, AS_OF)
    updated = state.update_tracking(tracked, recovered, current, F.lit(LOGGED_AT).cast("timestamp"))
    bucket_state.replace_buckets(updated, path, key)
    return bucket_state.read_buckets(t.spark, path)


@query("s8_zero_fill")
def _(t):
    key = F.col("o_orderkey")
    value = (
        F.when(key % 5 == 0, F.lit(float("nan")))
        .when(key % 5 == 1, F.lit(float("inf")))
        .when(key % 5 == 2, F.lit(float("-inf")))
        .when(key % 5 == 3, F.lit(None).cast("double"))
        .otherwise(F.col("o_totalprice"))
    )
    count = F.when(key % 2 == 0, F.col("o_custkey"))
    raw = t.source("orders").select(
        key.alias("order_no"), value.alias("amount"), count.alias("customers")
    )
    return clean.zero_fill(raw)


# ---- conformed views --------------------------------------------------------------------


@query("c1_resolve_client")
def _(t):
    return conform.resolve_client(t["enquiry_facts"], t["client"], t["temp_client"]).select(
        "client_enquiry_id", "client_key", "client_name", "client_country", "client_sector"
    )


def _enquiry_view(t) -> DataFrame:
    return conform.enquiry_view(
        t["enquiry_facts"], t["client"], t["temp_client"], t["country"], t["region"]
    )


def _invoice_view(t) -> DataFrame:
    return conform.invoice_view(t["invoice"], t["client"], t["country"], t["region"])


def _country_activity(t, part=NO_SLICE) -> DataFrame:
    return conform.country_activity(t["client_activity"], t["country"], t["region"], part)


def _client_activity(t, part=NO_SLICE) -> DataFrame:
    return conform.client_activity(
        t["client_activity"], t["client"], t["temp_client"], t["client_type"], W, part
    )


def _activity_codes(t, part=NO_SLICE) -> DataFrame:
    return conform.activity_code_summary(
        t["activity_code_activity"], t["job_activity"], t["country"], t["region"], part
    )


@query("c2_enquiry_view")
def _(t):
    return _enquiry_view(t).withColumn("amount", report_money(F.col("amount"))).drop("client_ref")


@query("c3_invoice_view")
def _(t):
    return _invoice_view(t).withColumn("invoice_amount", report_money(F.col("invoice_amount")))


@query("c4_country_activity")
def _(t):
    return _country_activity(t)


@query("c4_country_activity_sliced")
def _(t):
    return _country_activity(t, SLICE)


@query("c5_client_activity")
def _(t):
    return _client_activity(t)


@query("c5_client_activity_sliced")
def _(t):
    return _client_activity(t, PLACE)


@query("c6_activity_code_summary")
def _(t):
    return _activity_codes(t)


@query("c6_activity_code_summary_sliced")
def _(t):
    return _activity_codes(t, Slice(division=3, region=2, sector=2))


@query("c7_last_activity_by_division")
def _(t):
    return conform.last_activity_by_division(t["client_activity"])


def _kept(t, table: str, rollup: rollups.Rollup) -> DataFrame:
    """A rollup of a snapshot, brought up to date after the jobs of one year were written again, a month later each."""
    folder = _run_folder(t.spark)
    source, target = f"{folder}/{table}", f"{folder}/{table}-rollup"
    snapshots.write_snapshot(t[table], source, "enquiry_date")
    rollups.refresh(t.spark, source, target, rollup)
    later = t[table].withColumn("job_date", F.date_add("job_date", 30))
    snapshots.write_snapshot(later, source, "enquiry_date", years=[CHANGED_YEAR])
    rollups.refresh(t.spark, source, target, rollup)  # reads the one year
    return rollups.read_rollup(t.spark, target)


@query("c4_country_activity_kept")
def _(t):
    """C4 from a rollup of which one year was worked out again."""
    return conform.country_activity(_kept(t, "client_activity", rollups.activity_rollup(W.floor)), t["country"], t["region"])


@query("c5_client_activity_kept")
def _(t):
    """C5 from a rollup of which one year was worked out again."""
    kept = {"client_activity": _kept(t, "client_activity", rollups.activity_rollup(W.floor))}
    return _client_activity({**{n: t[n] for n in ("client", "temp_client", "client_type")}, **kept})


@query("c6_activity_codes_kept")
def _(t):
    """C6 from a rollup of which one year was worked out again."""
    kept = {"activity_code_activity": _kept(t, "activity_code_activity", rollups.CODE_ROLLUP)}
    return _activity_codes({**{n: t[n] for n in ("job_activity", "country", "region")}, **kept})


@query("c7_last_activity_by_division_kept")
def _(t):
    """C7 from a rollup of which one year was worked out again."""
    return conform.last_activity_by_division(_kept(t, "client_activity", rollups.activity_rollup(W.floor)))


@query("c8_gross_net_amounts")
def _(t):
    names = ("gross_amount", "net_amount", "outstanding")
    return conform.gross_net_amounts(t["invoice"]).select(
        "trans_no", *[report_money(F.col(n)).alias(n) for n in names]
    )


# ---- slices and predicates --------------------------------------------------------------


def _sums(df: DataFrame, amount: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), report_money(F.sum(amount)).alias("amount")
    )


@query("f1_slice_by_division")
def _(t):
    return _sums(slices.slice_by(_enquiry_view(t), SLICE), "amount", "country_id")


@query("f1_slice_by_place")
def _(t):
    part = Slice(region=2, sector=2)
    return _sums(slices.slice_by(_invoice_view(t), part), "invoice_amount", "country_id", "division")


@query("f1_slice_by_text_key")
def _(t):
    columns = {"country": "country", "sector": "temp_client_type"}
    return slices.slice_by(t["temp_client"], Slice(sector=2), columns)


@query("f2_lifecycle_segments")
def _(t):
    kinds = [*slices.ENQUIRY_KINDS, *slices.JOB_KINDS]
    row = _client_activity(t).agg(
        *[F.expr(f"count_if({slices.segment(k, W)})").alias(k) for k in kinds]
    )
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("clients")) for k in kinds])
    return row.select(F.inline(pairs))


@query("f2_lifecycle_filter")
def _(t):
    return slices.lifecycle_filter(_client_activity(t), "inactive_enq", W).select(
        "client_ref", "enquiry_date"
    )


@query("f3_in_group")
def _(t):
    gcc = slices.in_group(_invoice_view(t), "country_id", GCC_COUNTRIES)
    return _sums(gcc, "invoice_amount", "country_id")


@query("f4_between_dates")
def _(t):
    recent = slices.between_dates(
        _invoice_view(t), "tran_date", W.previous_from, W.previous_to
    )
    return _sums(recent, "invoice_amount", "division")


@query("f5_exclude_other_slice")
def _(t):
    others = slices.exclude_other_slice(_enquiry_view(t), 3, 107)
    return _sums(others, "amount", "division")


@query("f6_high_value")
def _(t):
    facts = t["enquiry_facts"].withColumn(
        "amount", conform.amount(F.col("aprox_amount"), F.col("rate"))
    )
    return slices.high_value(facts).select("client_enquiry_id", report_money(F.col("amount")).alias("amount"))


# ---- KPIs -------------------------------------------------------------------------------


def _enquiry_totals(t, part=NO_SLICE) -> DataFrame:
    return kpis.enquiry_totals(t["enquiry"], t["client"], t["country"], W, part)


def _invoice_totals(t, part=NO_SLICE, w=W) -> DataFrame:
    return kpis.invoice_totals(t["invoice"], t["client"], t["country"], w, part)


@query("k1_country_lifecycle_counts")
def _(t):
    return kpis.country_lifecycle_counts(_country_activity(t), W)


@query("k1_country_lifecycle_counts_sliced")
def _(t):
    return kpis.country_lifecycle_counts(_country_activity(t, SLICE), W)


@query("k2_client_lifecycle_counts")
def _(t):
    return kpis.client_lifecycle_counts(_client_activity(t), W)


@query("k3_activity_code_lifecycle_counts")
def _(t):
    return kpis.activity_code_lifecycle_counts(_activity_codes(t), W)


@query("k4_client_status_counts")
def _(t):
    return kpis.client_status_counts(_client_activity(t), W)


@query("k5_enquiry_growth")
def _(t):
    return kpis.enquiry_growth(_enquiry_totals(t))


@query("k5_enquiry_growth_by_region")
def _(t):
    return kpis.enquiry_growth(_enquiry_totals(t, REGION), 2)


@query("k6_invoice_growth")
def _(t):
    return kpis.invoice_growth(_invoice_totals(t))


@query("k6_invoice_growth_sliced")
def _(t):
    return kpis.invoice_growth(_invoice_totals(t, Slice(division=3, region=2, sector=2)))


@query("k7_enquiry_share_by_division")
def _(t):
    return kpis.enquiry_share_by_division(_enquiry_totals(t))


@query("k7_enquiry_share_without_transfers")
def _(t):
    return kpis.enquiry_share_by_division(_enquiry_totals(t), include_transfers=False)


@query("k8_enquiry_by_sector")
def _(t):
    return kpis.enquiry_by_sector(_enquiry_totals(t), t["client_type"])


@query("k8_enquiry_by_sector_wide")
def _(t):
    return kpis.figures_row(_enquiry_totals(t), kpis.sector_figures("enquiry", "active"))


@query("k9_invoice_by_sector")
def _(t):
    return kpis.invoice_by_sector(_invoice_totals(t), t["client_type"])


@query("k10_invoice_share_by_division")
def _(t):
    return kpis.invoice_share_by_division(_invoice_totals(t))


@query("k10_invoice_share_listed")
def _(t):
    return kpis.invoice_share_by_division(_invoice_totals(t), non_marine=[10, 11])


@query("k6_invoice_growth_job_window")
def _(t):
    return kpis.invoice_growth(_invoice_totals(t, w=JOB_WINDOWS))


@query("k9_invoice_by_sector_job_window")
def _(t):
    return kpis.invoice_by_sector(_invoice_totals(t, w=JOB_WINDOWS), t["client_type"])


@query("k11_idle_counts")
def _(t):
    return kpis.idle_counts(t["client_activity"], W, SLICE)


@query("k12_safe_percent")
def _(t):
    listed = listings.country_listing(t, W)
    lost, total = F.col("lost_enquiry_amount"), F.col("total_enquiry_amount")
    return listed.select(
        "country_id",
        safe_percent(lost, total).alias("lost_percent"),
        safe_percent(lost, total - total).alias("of_nothing"),
        safe_divide(total, F.lit(None)).alias("of_null"),
    )


@query("k13_kpi_metrics")
def _(t):
    return kpi_metrics(t, W)


@query("k13_kpi_metrics_sliced")
def _(t):
    return kpi_metrics(t, W, SLICE)


@query("k13_kpi_board")
def _(t):
    return whole_board(t, W)


@query("k13_kpi_board_sliced")
def _(t):
    return whole_board(t, W, PLACE)


@query("k13_sliced_boards")
def _(t):
    """The boards of the company and of every slice of one or two keys."""
    return sliced_boards(t, W)


def _stored_sets(t) -> DataFrame:
    """The bitmaps of the clients, written once and read back."""
    folder = f"{_run_folder(t.spark)}/client_sets"
    snapshots.write_snapshot(bitmaps.client_sets(t["client_activity"], t["client"], W), folder, rows_per_file=bitmaps.ROWS_PER_FILE)
    return snapshots.read_snapshot(t.spark, folder)


@query("k2_client_counts_from_bitmaps")
def _(t):
    """K2, K4 and idle clients of the company and of all slices of one key, from one stored table."""
    return bitmaps.sliced_counts(_stored_sets(t), W, [(), *[(key,) for key in bitmaps.KEYS]])


@query("l8_listing_counts_from_bitmaps")
def _(t):
    """How many clients the listings of each kind have in one division."""
    return bitmaps.listing_sizes(_stored_sets(t), W, DIVISION)


# ---- listings ---------------------------------------------------------------------------


@query("l1_country_listing")
def _(t):
    return listings.country_listing(t, W)


@query("l1_country_listing_sliced")
def _(t):
    return listings.country_listing(
        t, W, "job_active", DIVISION, W.inactive_from, W.active_to, "lost_amount", False
    )


@query("l2_idle_country_listing")
def _(t):
    return listings.idle_country_listing(t, W, "idle_enq", SLICE)


@query("l2_idle_country_listing_jobs")
def _(t):
    return listings.idle_country_listing(t, W, "idle_job", SLICE)


@query("l3_client_listing")
def _(t):
    return listings.client_listing(t, W)


@query("l3_client_listing_sliced")
def _(t):
    return listings.client_listing(
        t, W, "active_enq", Slice(division=3, region=2), W.active_from, W.active_to
    )


@query("l4_idle_client_listing")
def _(t):
    return listings.idle_client_listing(t, W, "idle_enq", DIVISION)


@query("l4_idle_client_listing_jobs")
def _(t):
    return listings.idle_client_listing(t, W, "idle_job", DIVISION)


@query("l5_enquiry_status_by_country")
def _(t):
    return listings.enquiry_status_rollup(t, "country")


@query("l5_enquiry_status_by_client")
def _(t):
    return listings.enquiry_status_rollup(t, "client")


@query("l5_enquiry_status_by_client_sliced")
def _(t):
    return listings.enquiry_status_rollup(t, "client", Slice(sector=2))


@query("l6_invoice_rollup_by_country")
def _(t):
    return listings.invoice_rollup(t, "country")


@query("l6_invoice_rollup_by_client")
def _(t):
    return listings.invoice_rollup(t, "client")


@query("l6_invoice_rollup_by_client_sliced")
def _(t):
    return listings.invoice_rollup(t, "client", DIVISION, W.inactive_from, W.active_to)


@query("l7_sort_by_name")
def _(t):
    rows = listings.enquiry_status_rollup(t, "country").join(
        listings.invoice_rollup(t, "country"), "country_id", "left"
    )
    shown = rows.select("country_id", "lost_enquiry_count", "total_invoice_count")
    placed = numbered(shown, listings.sort_keys(shown, "lost_enquiry", default="lost_enquiry_count"), name="place")
    return listings.sort_by_name(placed, "lost_enquiry", default="lost_enquiry_count")


@query("l8_listing_count")
def _(t):
    clients = listings.listing_count(listings.listed_clients(t, W, "active_enq"))
    countries = listings.listing_count(listings.listed_countries(t, W, "active_enq"))
    return clients.select(F.lit("clients").alias("listing"), "entities").unionByName(
        countries.select(F.lit("countries").alias("listing"), "entities")
    )


# ---- rankings ---------------------------------------------------------------------------


@query("t1_top_clients_by_enquiry")
def _(t):
    return rankings.top_clients_by_enquiry(t, W)


@query("t1_top_clients_by_enquiry_sliced")
def _(t):
    return rankings.top_clients_by_enquiry(t, W, 5, Slice(division=3, region=2), scale=1)


@query("t2_enquiry_by_region")
def _(t):
    return rankings.enquiry_by_region(t, W)


@query("t3_enquiry_by_country")
def _(t):
    return rankings.enquiry_by_country(t, W)


@query("t3_enquiry_by_country_sliced")
def _(t):
    return rankings.enquiry_by_country(t, W, part=SLICE)


@query("t4_top_clients_by_invoice")
def _(t):
    return rankings.top_clients_by_invoice(t, W)


@query("t5_invoice_by_region")
def _(t):
    return rankings.invoice_by_region(t, W)


@query("t5_invoice_by_region_sliced")
def _(t):
    return rankings.invoice_by_region(t, W, Slice(country=6))


@query("t5_invoice_by_region_with_amounts")
def _(t):
    return rankings.invoice_by_region(t, W, Slice(country=6), all_regions=False)


@query("t2_enquiry_by_region_with_amounts")
def _(t):
    return rankings.enquiry_by_region(t, W, SLICE, all_regions=False)


@query("t3_enquiry_by_country_with_amounts")
def _(t):
    return rankings.enquiry_by_country(t, W, None, all_countries=False)


@query("t6_invoice_by_country_with_amounts")
def _(t):
    return rankings.invoice_by_country(t, W, None, all_countries=False)


@query("t4_top_clients_by_invoice_job_window")
def _(t):
    return rankings.top_clients_by_invoice(t, JOB_WINDOWS)


@query("t6_invoice_by_country_job_window")
def _(t):
    return rankings.invoice_by_country(t, JOB_WINDOWS)


@query("t6_invoice_by_country")
def _(t):
    return rankings.invoice_by_country(t, W)


@query("t7_client_invoice_totals")
def _(t):
    return rankings.client_invoice_totals(t, W)


# ---- report datasets --------------------------------------------------------------------


@query("r1_outstanding_lines")
def _(t):
    lines = reports.outstanding_lines(t, AS_OF)
    return lines.withColumns({b: report_money(F.col(b)) for b in reports.BALANCES})


@query("r2_outstanding_by_client")
def _(t):
    return reports.outstanding_by_client(t, AS_OF).drop("divisions")


@query("r3_outstanding_with_total")
def _(t):
    return reports.outstanding_with_total(reports.outstanding_by_client(t, AS_OF))


@query("r4_payment_job_latency")
def _(t):
    return reports.payment_job_latency(t)


@query("r5_latency_buckets")
def _(t):
    return (
        reports.latency_buckets(reports.payment_job_latency(t))
        .groupBy("bucket")
        .agg(F.count("*").alias("n"), F.max("months_diff").alias("longest"))
    )


@query("r6_weekly_division_summary")
def _(t):
    return reports.weekly_division_summary(t["enquiry_facts"], *LOSSES, location=None)


@query("r6_weekly_division_summary_local")
def _(t):
    return reports.weekly_division_summary(t["enquiry"], *LOSSES, location=1)


@query("r6_last_eight_days")
def _(t):
    return reports.weekly_division_summary(t["enquiry"], *reports.last_days(WEEK_DAY), location=1)


@query("r7_last_eight_days")
def _(t):
    return reports.top_subdivision_per_group(
        t["enquiry"], t["dimension"], *reports.last_days(WEEK_DAY), location=1
    )


@query("r7_top_subdivision_per_group")
def _(t):
    return reports.top_subdivision_per_group(
        t["enquiry_facts"], t["dimension"], *LOSSES, location=None
    )


@query("r8_daily_enquiry_series")
def _(t):
    return reports.daily_enquiry_series(t["enquiry_facts"], FLOOR, AS_OF, location=None)


@query("r9_fill_calendar_gaps")
def _(t):
    series = reports.daily_enquiry_series(t["enquiry"], *SERIES, location=1)
    return reports.fill_calendar_gaps(series, *SERIES, GROUPS)


@query("r10_idle_improvements")
def _(t):
    """Idle as seen from the activity up to a year ago, and not idle by now."""
    divisions = tuple(DIVISION_NAMES)
    before = conform.with_directory(
        listings.idle_in_divisions(_a_year_ago(t, "enquiry_date"), W, divisions),
        t["client"], t["temp_client"], ("client_ref", "division_id"),
    )
    now = listings.idle_in_divisions(t, W, divisions)
    return reports.idle_improvements(before, now).select(
        "division_id", "client_ref", "client_name"
    )


@query("r10_idle_improvements_by_buckets")
def _(t):
    """R10 against a stored state: only buckets with other clients than a year ago are read and compared."""
    divisions, key = tuple(DIVISION_NAMES), ["division_id", "client_ref"]
    before = conform.with_directory(
        listings.idle_in_divisions(_a_year_ago(t, "enquiry_date"), W, divisions),
        t["client"], t["temp_client"], ("client_ref", "division_id"),
    )
    path = f"{_run_folder(t.spark)}/idle"
    bucket_state.replace_buckets(before.select(*key, "client_name"), path, key, of=key)
    now = listings.idle_in_divisions(t, W, divisions)
    changed = bucket_state.changed_buckets(now, path)
    return reports.idle_improvements(
        bucket_state.read_buckets(t.spark, path, changed), bucket_state.in_buckets(now, path, changed)
    ).select("division_id", "client_ref", "client_name")


@query("r11_idle_snapshot_all_divisions")
def _(t):
    return listings.idle_snapshot_all_divisions(t, W, tuple(DIVISION_NAMES))


@query("r12_inactive_clients")
def _(t):
    return reports.inactive_clients(t, AS_OF)


@query("r13_recovered_clients")
def _(t):
    return _recovered(t)


@query("r14_bucket_by_division_group")
def _(t):
    return reports.bucket_by_division_group(reports.inactive_clients(t, AS_OF))


@query("r14_recovered_by_division_group")
def _(t):
    return reports.recovered_by_division_group(_recovered(t))


def _losses(t) -> DataFrame:
    return reports.lost_cancelled_enquiries(t, *LOSSES)


@query("r15_lost_cancelled_enquiries")
def _(t):
    return _losses(t).select(
        "*", report_money(F.col("exact_amount")).alias("amount")
    ).drop("exact_amount")


@query("r16_with_subtotals")
def _(t):
    return reports.with_subtotals(_losses(t))


@query("r17_monthly_loss_trend")
def _(t):
    return reports.monthly_loss_trend(t["enquiry_facts"], AS_OF)


@query("r18_loss_trend_pivot")
def _(t):
    return reports.loss_trend_pivot(reports.monthly_loss_trend(t["enquiry_facts"], AS_OF, 72))


@query("r19_monthly_revenue")
def _(t):
    return reports.monthly_revenue(t, LAST_MONTH)


@query("r20_revenue_drop")
def _(t):
    return reports.revenue_drop(
        reports.monthly_revenue(t, LAST_MONTH), reports.monthly_revenue(t, THIS_MONTH)
    )


def _by_invoice(t) -> dict[str, DataFrame]:
    """The tables, invoices and payments in buckets by number and type of the invoice."""
    folder = _run_folder(t.spark)
    paid = t["payment_allocation"].select("trans_no_to", "trans_type_to", "trans_type_from", "date_alloc", "alloc_amount")
    billed = t["invoice"].select("trans_no", "trans_type", "debtor_no", "dimension2_id", "rate")
    bucketed.write_bucketed(paid, f"{folder}/payment_allocation", ["trans_no_to", "trans_type_to"], BUCKETS, "date_alloc")
    bucketed.write_bucketed(billed, f"{folder}/invoice", ["trans_no", "trans_type"], BUCKETS)
    dealt = {n: bucketed.read_bucketed(t.spark, f"{folder}/{n}") for n in ("payment_allocation", "invoice")}
    return {**{n: t[n] for n in ("client", "dimension")}, **dealt}


@query("r19_monthly_revenue_bucketed")
def _(t):
    """R19 on tables in buckets, which meet without a shuffle."""
    return reports.monthly_revenue(_by_invoice(t), LAST_MONTH)


@query("r20_revenue_drop_bucketed")
def _(t):
    """R20 on tables in buckets, which meet without a shuffle."""
    return reports.revenue_drop_from_payments(_by_invoice(t), THIS_MONTH)


@query("r20_revenue_drop_in_one_pass")
def _(t):
    return reports.revenue_drop_from_payments(t, THIS_MONTH)


@query("r21_high_value_enquiries")
def _(t):
    return reports.high_value_enquiries(t)


@query("r22_numbered")
def _(t):
    rows = _losses(t).select(
        "client_enquiry_id", "division_id", "subdivision_name", "enquiry_date"
    )
    order = [F.col("subdivision_name"), F.col("enquiry_date"), F.col("client_enquiry_id")]
    return numbered(rows, order, ["division_id", "subdivision_name"])


@query("r22_numbered_outstanding")
def _(t):
    rows = reports.outstanding_by_client(t, AS_OF).select("debtor_no", "client_name", "bal_6m")
    return numbered(rows, [F.col("bal_6m").desc(), F.col("debtor_no")])


@query("r23_compact_amount")
def _(t):
    value = conform.amount(F.col("aprox_amount"), F.col("rate"))
    amounts = t["enquiry_facts"].groupBy("subdivision", "enq_status").agg(
        F.sum(value).alias("amount"), F.max("enq_status").alias("small")
    )
    return amounts.select(
        "subdivision",
        "enq_status",
        compact_amount(F.col("amount")).alias("amount_text"),
        compact_amount(F.col("amount") * F.expr("0.001BD")).alias("thousands_text"),
        compact_amount(F.col("small")).alias("small_text"),
    )
