from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from clientlens import Slice, Windows
from clientlens.operators import conform, kpis

W = Windows(as_of=date(2024, 6, 30))
DAY = date(2024, 3, 1)


@pytest.fixture
def clients(frame):
    return frame(
        "debtor_no BIGINT, name STRING, country INT, client_type INT, client_status INT",
        (5, "five", 1, 1, 6), (6, "six", 2, 5, 1), (7, "seven", 1, None, 2),
    )


@pytest.fixture
def temps(frame):
    return frame(
        "temp_clients_id BIGINT, client_name STRING, country STRING, temp_client_type STRING",
        (5, "temp five", "2", "2"), (3, "temp three", "", ""), (4, "temp four", " 1 ", "x"),
    )


@pytest.fixture
def countries(frame):
    return frame(
        "id INT, name STRING, region_id INT, colour_code STRING",
        (1, "one", 10, "#1"), (2, "two", 20, "#2"), (3, "three", None, "#3"),
    )


@pytest.fixture
def regions(frame):
    return frame("id INT, name STRING", (10, "ten"), (20, "twenty"), (30, "empty"))


@pytest.fixture
def enquiries(frame):
    rows = [
        (1, 5, 0), (2, 0, 5), (3, 0, 3), (4, None, 3), (5, 0, 0), (6, None, None), (7, 6, 0),
        (8, 7, 0), (9, 99, 5),
    ]
    return frame(
        "client_enquiry_id BIGINT, debtor_no BIGINT, enquiry_temp_id BIGINT", *rows
    ).select(
        "*",
        F.lit(DAY).alias("enquiry_date"),
        F.lit(0).alias("enq_status"),
        F.lit(3).alias("division"),
        F.lit(100).alias("subdivision"),
        F.lit(10).cast("decimal(18,4)").alias("aprox_amount"),
        F.lit(2).cast("decimal(12,6)").alias("rate"),
    )


def test_each_enquiry_finds_its_client(enquiries, clients, temps):
    rows = conform.resolve_client(enquiries, clients, temps).collect()
    found = {r["client_enquiry_id"]: (r["client_key"], r["client_name"]) for r in rows}
    assert found == {
        1: ("5", "five"),
        2: ("TMP5", "temp five"),
        3: ("TMP3", "temp three"),
        4: ("TMP3", "temp three"),
        5: (None, None),
        6: (None, None),
        7: ("6", "six"),
        8: ("7", "seven"),
        9: ("99", None),  # a registered number never shows under a temporary client's name
    }


def test_blank_ids_of_temporary_clients_are_null(clients, temps):
    rows = conform.client_directory(clients, temps).collect()
    found = {r["client_ref"]: (r["country_id"], r["client_type"]) for r in rows}
    assert found[-3] == (None, None)
    assert found[-4] == (1, None)
    assert found[-5] == (2, 2)
    assert len(found) == len(rows) == 6


def test_view_leaves_out_excluded_and_unknown_sectors(enquiries, clients, temps, countries, regions):
    rows = conform.enquiry_view(enquiries, clients, temps, countries, regions).collect()
    assert {r["client_enquiry_id"]: r["region_name"] for r in rows} == {1: "ten", 2: "twenty"}
    assert {float(r["amount"]) for r in rows} == {20.0}


@pytest.fixture
def activity(frame):
    old, floor = date(2019, 1, 1), W.floor
    return frame(
        "debtor_no BIGINT, temp_client_id BIGINT, division INT, sub_division INT, country_id INT,"
        " region_id INT, client_type INT, enquiry_date DATE, job_date DATE",
        (5, 0, 3, 1, 1, 10, 1, DAY, None),
        (5, 0, 4, 2, 1, 10, 1, date(2021, 1, 1), DAY),
        (None, 5, 3, 1, 2, 20, 2, DAY, None),
        (0, 5, 4, 1, 2, 20, 2, DAY, None),
        (6, 0, 3, 1, 1, 10, 5, DAY, DAY),      # excluded sector
        (7, 0, 3, 1, 1, 10, None, DAY, DAY),   # unknown sector
        (8, 0, 4, 1, 3, None, 1, DAY, None),   # country without region
        (9, 0, 4, 1, 0, None, 1, DAY, None),   # no country
        (10, 0, 4, 1, 1, 10, 1, old, old),     # before the floor
        (11, 0, 4, 1, 1, 10, 1, floor, None),  # on the floor
    )


def test_debtor_and_temporary_client_of_one_number_stay_apart(activity, clients, temps, frame):
    sectors = frame("id INT, client_type STRING", (1, "industrial"), (2, "marine"))
    rows = conform.client_activity(activity, clients, temps, sectors, W).collect()
    found = {r["client_ref"]: (r["client_id"], r["client_status"], r["client_name"]) for r in rows}
    assert found == {
        5: ("5", "", "five"), -5: ("5", "TMP5", "temp five"), 8: ("8", "", None),
        11: ("11", "", None),
    }
    counts = kpis.client_lifecycle_counts(
        conform.client_activity(activity, clients, temps, sectors, W), W
    ).first()
    assert counts["enquiry_total"] == 3  # the one on the floor is not in
    assert counts["job_total"] == 1


def test_country_activity_and_its_counts(activity, countries, regions):
    found = conform.country_activity(activity, countries, regions)
    rows = {r["country_id"]: r for r in found.collect()}
    assert set(rows) == {1, 2, 3}
    assert rows[3]["region_name"] is None
    assert rows[1]["job_date"] == DAY
    sliced = conform.country_activity(activity, countries, regions, Slice(division=3))
    assert kpis.country_lifecycle_counts(sliced, W).first()["countries"] == 2


def test_idle_needs_history_and_no_presence(activity):
    counts = {r["entity"]: r for r in kpis.idle_counts(activity, W, Slice(division=3)).collect()}
    # country 3 has history only in division 4; clients 8 as well (11 only on the floor)
    assert counts["countries"]["idle_enquiry"] == 1
    assert counts["clients"]["idle_enquiry"] == 1
    assert counts["countries"]["idle_job"] == 1  # country 1 has its job in division 4
    assert counts["clients"]["idle_job"] == 1


def test_no_invoices_give_zero_and_not_null(frame, clients, countries):
    none = frame(
        "debtor_no BIGINT, tran_date DATE, ov_amount DECIMAL(18,4), alloc DECIMAL(18,4),"
        " rate DECIMAL(12,6), total_expense_aed DECIMAL(18,4), dimension2_id INT, dimension3_id INT"
    )
    totals = kpis.invoice_totals(none, clients, countries, W)
    assert set(kpis.invoice_growth(totals).first().asDict().values()) == {0.0}
    shares = kpis.invoice_share_by_division(totals).collect()
    assert [r["percent"] for r in shares] == [0.0, 0.0, 0.0]


def test_missing_expense_counts_as_zero(frame):
    row = conform.gross_net_amounts(
        frame(
            "ov_amount DECIMAL(18,4), alloc DECIMAL(18,4), rate DECIMAL(12,6),"
            " total_expense_aed DECIMAL(18,4)"
        ).unionByName(
            frame("a INT", (1,)).selectExpr(
                "10BD AS ov_amount", "4BD AS alloc", "1.5BD AS rate", "CAST(NULL AS DECIMAL(18,4)) AS total_expense_aed"
            )
        )
    ).first()
    assert (row["gross_amount"], row["net_amount"], row["outstanding"]) == (15, 15, 9)


def test_names_with_quotes_and_ids_that_are_no_numbers(frame):
    totals = frame(
        "division INT, client_type INT, current_net DECIMAL(20,4)", (7, 1, Decimal(3)), (8, 1, Decimal(1))
    )
    shares = kpis.invoice_share_by_division(totals, {7: "O'Neil `x`"}).collect()
    assert [(r["division_group"], r["percent"]) for r in shares] == [
        ("O'Neil `x`", 75.0), ("Non Marine", 25.0),
    ]
    with pytest.raises(ValueError):
        kpis.invoice_share_by_division(totals, {"7 OR true": "x"})
