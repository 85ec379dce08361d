from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from clientlens import NO_SLICE, Slice, Windows
from clientlens.functions import compact_amount
from clientlens.operators import listings, reports
from clientlens.operators.kpis import client_last_activity
from clientlens.operators.numbering import numbered
from clientlens.operators.slices import has_history
from clientlens.plans.mapping import AS_OF, WINDOWS


@pytest.mark.parametrize(
    "paid, job, months, bucket",
    [
        (date(2024, 1, 31), date(2024, 3, 1), None, None),
        (date(2024, 1, 31), date(2024, 4, 1), 3, "3-6 months"),
        (date(2024, 1, 1), date(2024, 6, 30), 5, "3-6 months"),
        (date(2024, 1, 31), date(2024, 7, 1), 6, "6-12 months"),
        (date(2024, 1, 1), date(2025, 1, 31), 12, "6-12 months"),
        (date(2024, 1, 1), date(2025, 2, 1), 13, "over 12 months"),
    ],
)
def test_latency_counts_calendar_months(frame, paid, job, months, bucket):
    tables = {
        "client_activity": frame(
            "debtor_no BIGINT, division INT, job_date DATE, enquiry_date DATE", (1, 3, job, None)
        ),
        "credit_period": frame(
            "debtor_no BIGINT, date_of_curr_pmnt DATE, current_credit_period INT",
            (1, paid, 30), (1, date(2020, 1, 1), 60), (2, None, 10),
        ),
        "client": frame("debtor_no BIGINT, name STRING", (1, "one")),
        "dimension": frame("id INT, name STRING", (3, "ONE")),
    }
    rows = reports.latency_buckets(reports.payment_job_latency(tables)).collect()
    assert [(r["months_diff"], r["bucket"]) for r in rows] == ([(months, bucket)] if months else [])


def test_ties_go_to_the_lower_subdivision(frame):
    day = date(2024, 1, 1)
    rows = [(i, day, 3, sub, 1, 1) for i, sub in enumerate((7, 7, 5, 5, 9))]
    enquiry = frame(
        "client_enquiry_id BIGINT, enquiry_date DATE, division INT, subdivision INT,"
        " aprox_amount INT, rate INT", *rows
    )
    names = frame("id INT, name STRING", (5, "five"), (7, "seven"), (9, "nine"))
    best = reports.top_subdivision_per_group(enquiry, names, day, day, None).collect()
    assert [(r["div_group"], r["sub_name"], r["enquiry_count"]) for r in best] == [("ONE", "five", 2)]


def test_gaps_are_filled_for_every_day_and_group(frame):
    series = frame("enquiry_date DATE, div_group STRING, daily_count BIGINT", (date(2024, 2, 28), "ONE", 4))
    start, end = date(2024, 2, 27), date(2024, 3, 2)
    filled = reports.fill_calendar_gaps(series, start, end, ["ONE", "I&M", "Other"]).collect()
    assert len(filled) == 5 * 3
    assert sum(r["daily_count"] for r in filled) == 4


def test_revenue_drop(frame):
    ddl = "division STRING, division_id INT, debtor_no BIGINT, client_name STRING, revenue DOUBLE"
    before = frame(ddl, ("ONE", 3, 1, "a", 10.0), ("ONE", 3, 2, "b", 10.0), ("X", 9, 3, "c", 5.0), ("X", 9, 4, "d", 5.0))
    now = frame(ddl, ("ONE", 3, 1, "a", 9.0), ("ONE", 3, 2, "b", 12.0), ("X", 9, 3, "c", 3.5), ("ONE", 3, 4, "d", 5.0))
    rows = reports.revenue_drop(before, now).orderBy("debtor_no").collect()
    assert [(r["debtor_no"], r["revenue_drop"], r["div_group"]) for r in rows] == [
        (3, 1.5, "Other"), (4, 5.0, "Other"),
    ]
    assert reports.revenue_drop(before, before).count() == 0


def test_unknown_clients_are_named_so(frame):
    day = date(2024, 1, 1)
    enquiry = frame(
        "book_no STRING, debtor_no BIGINT, branch_code INT, enquiry_temp_id BIGINT, enq_status INT",
        ("a", 5, 1, 0, 0), ("b", 0, 0, 5, 5), ("c", 0, 0, 0, 9), ("d", 5, 0, 0, 2), ("e", 0, 0, 0, 1),
    ).select(
        "*", F.lit(day).alias("enquiry_date"), F.lit(1).alias("company"), F.lit(3).alias("division"),
        F.lit(7).alias("subdivision"), F.lit(500000.5).alias("aprox_amount"), F.lit(1).alias("rate"),
        F.lit(0).alias("parent_id"), F.lit(1).alias("is_active"), F.lit(6).alias("enq_type"),
    )
    tables = {
        "enquiry": enquiry,
        "client": frame(
            "debtor_no BIGINT, name STRING, country INT, client_type INT, client_status INT",
            (5, "five", 1, 1, 1),
        ),
        "temp_client": frame(
            "temp_clients_id BIGINT, client_name STRING, country STRING, temp_client_type STRING",
            (5, "temp", "", ""),
        ),
        "country": frame("id INT, name STRING", (1, "one")),
        "dimension": frame("id INT, name STRING", (3, "ONE")),
    }
    rows = reports.high_value_enquiries(tables, day, day).orderBy("book_no").collect()
    assert [(r["book_no"], r["client"], r["country"]) for r in rows] == [
        ("a", "five", "one"), ("b", "temp", None), ("d", "Unknown", None), ("e", "Unknown", None),
    ]
    assert {r["enquiry_type"] for r in rows} == {"Other"}
    assert reports.high_value_enquiries(tables, date(2024, 1, 2), None).count() == 0


def test_numbers_run_through_each_section(spark):
    """One section holds most rows and spans several partitions; order is descending."""
    df = spark.range(5000).select(
        F.when(F.col("id") % 10 < 8, "big").when(F.col("id") % 10 == 8, "small").alias("section"),
        (F.col("id") * 7919 % 5003).alias("value"),
    )
    rows = numbered(df, [F.col("value").desc()], ["section"]).collect()
    assert len(rows) == 5000
    for section in ("big", "small", None):
        inside = sorted((r for r in rows if r["section"] == section), key=lambda r: r["no"])
        assert [r["no"] for r in inside] == list(range(1, len(inside) + 1))
        values = [r["value"] for r in inside]
        assert values == sorted(values, reverse=True)


def test_numbers_without_sections(spark):
    rows = numbered(spark.range(1000), [F.col("id")]).collect()
    assert all(r["no"] == r["id"] + 1 for r in rows)


# ---- properties over the sample -----------------------------------------------------------


def total(df, name):
    return df.agg(F.sum(F.col(name).cast("decimal(38,4)")).alias("t")).first()["t"]


def test_country_listing_adds_up_to_the_rollup(sample):
    listing = listings.country_listing(sample, WINDOWS)
    rollup = listings.enquiry_status_rollup(sample, "country")
    for name in ("total_enquiry_count", "lost_enquiry_amount"):
        assert total(listing, name) == total(rollup, name)


def test_divisions_add_up_to_the_whole(sample):
    """On the exact sums, before reports round them."""
    names = ("total_invoice_amount", "total_enquiry_amount", "lost_enquiry_count")

    def sums(part):
        business = listings.client_business(sample, part)
        return business.agg(*[F.sum(n).alias(n) for n in names]).first().asDict()

    parts = [sums(Slice(division=d)) for d in (225, 3, 10, 11, 12)]
    whole = sums(NO_SLICE)
    assert {n: sum(p[n] for p in parts) for n in names} == whole


def test_idle_and_present_clients_are_disjoint_and_complete(sample):
    part = Slice(division=3)
    last = client_last_activity(sample["client_activity"], WINDOWS, NO_SLICE, part).filter("client_ref > 0")
    present = last.filter(has_history("enquiry_here", WINDOWS)).select("client_ref")
    idle = listings.idle_clients(sample, WINDOWS, "idle_enq", part).select("client_ref")
    assert idle.join(present, "client_ref", "left_semi").count() == 0
    with_history = last.filter(has_history("enquiry_all", WINDOWS)).count()
    assert idle.count() + present.count() == with_history
    assert idle.count() > 0


def test_snapshot_of_divisions_equals_single_listings(sample):
    both = listings.idle_snapshot_all_divisions(sample, WINDOWS, (225, 3))
    for division in (225, 3):
        single = listings.idle_client_listing(sample, WINDOWS, "idle_enq", Slice(division=division))
        part = both.filter(F.col("division_id") == division).drop("division_id")
        assert part.exceptAll(single).count() == single.exceptAll(part).count() == 0


def test_subtotals_add_up_to_totals(sample):
    detail = reports.lost_cancelled_enquiries(sample, date(1995, 1, 1), AS_OF)
    rows = reports.with_subtotals(detail).collect()
    for division in {r["division_id"] for r in rows}:
        own = [r for r in rows if r["division_id"] == division]
        whole = [r for r in own if r["level"] == "total"]
        assert len(whole) == 1
        assert sum(r["enquiries"] for r in own if r["level"] == "subtotal") == whole[0]["enquiries"]


def test_division_map_and_text_agree(sample):
    for row in reports.outstanding_by_client(sample, AS_OF).collect():
        text = "; ".join(f"{d}: {', '.join(s)}" for d, s in sorted(row["divisions"].items()))
        assert text == row["division_text"]


def test_recovered_and_inactive_do_not_meet(sample):
    inactive = reports.inactive_clients(sample, AS_OF)
    tracked = inactive.select("debtor_no", "division_id", "last_job_date")
    assert reports.recovered_clients(tracked, sample, AS_OF).count() == 0


# ---- order, windows and large amounts -------------------------------------------------------


@pytest.mark.parametrize(
    "build, key",
    [
        (lambda t: reports.outstanding_by_client(t, AS_OF), lambda r: (-r["bal_6m"], r["debtor_no"])),
        (reports.payment_job_latency, lambda r: (-r["months_diff"], r["debtor_no"], r["division_name"])),
        (
            lambda t: reports.lost_cancelled_enquiries(t, date(2001, 1, 1), date(2001, 8, 1)),
            lambda r: (r["subdivision_name"], r["enquiry_date"], r["client_enquiry_id"]),
        ),
        (
            lambda t: reports.daily_enquiry_series(t["enquiry"], date(2001, 1, 1), AS_OF, None),
            lambda r: (r["enquiry_date"], r["div_group"]),
        ),
        (lambda t: reports.monthly_loss_trend(t["enquiry"], AS_OF), lambda r: (r["month"], r["division"])),
    ],
)
def test_reports_come_in_order(sample, build, key):
    found = build(sample).collect()
    assert len(found) > 1 and found == sorted(found, key=key)


def test_latency_has_all_buckets(sample):
    found = reports.latency_buckets(reports.payment_job_latency(sample)).select("bucket").distinct().collect()
    assert {r["bucket"] for r in found} == {"3-6 months", "6-12 months", "over 12 months"}


def test_job_window_may_differ_from_the_active_one():
    w = Windows(as_of=date(2024, 6, 30))
    assert (w.job_from, w.job_to) == (w.active_from, w.active_to)
    assert (w.previous_job_from, w.previous_job_to) == (w.previous_from, w.previous_to)
    w = Windows(as_of=date(2024, 6, 30), job_day=date(2024, 3, 31), job_months=3)
    assert (w.previous_job_from, w.job_from, w.job_to) == (date(2023, 9, 30), date(2023, 12, 31), date(2024, 3, 31))
    assert w.active_from == date(2023, 6, 30)


def test_compact_amount_of_grand_totals(spark):
    texts = {
        "123456789012345678901234567.8949": "123456789012345678901.23M",
        "-1234567890123456789.5": "-1234567890123.46M",
        "1234999.9999": "1.23M",
        "999999.9999": "1000.0K",
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    shown = df.select("t", compact_amount(F.col("t").cast("decimal(38,4)")))
    assert dict(map(tuple, shown.collect())) == texts
