"""Datasets behind the periodic reports."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientlens.functions import report_money, safe_percent
from clientlens.model import (
    CANCELLED,
    CRITICAL_CATEGORY,
    CUSTOMER_PAYMENT,
    DIVISION_NAMES,
    ENQUIRY_STATUS,
    ENQUIRY_TYPE,
    EXCLUDED_SECTOR,
    HIGH_VALUE,
    LOST,
    NON_MARINE_GROUP,
    OTHER_GROUP,
    months_before,
)
from clientlens.operators import conform
from clientlens.operators.slices import between_dates, high_value

Tables = Mapping[str, DataFrame]


def division_group(
    division: Column, names: Mapping[int, str] = DIVISION_NAMES, other: str = OTHER_GROUP
) -> Column:
    label = F.lit(other)
    for number, name in names.items():
        label = F.when(division == number, name).otherwise(label)
    return label


def _decode(code: Column, names: Mapping[int, str], other: str | None = "Other") -> Column:
    label = F.lit(other)
    for number, name in names.items():
        label = F.when(code == number, name).otherwise(label)
    return label


def _names(dimension: DataFrame, key: str, name: str) -> DataFrame:
    """The dimension table in one of its roles (company, division, sub-division)."""
    return dimension.select(F.col("id").alias(key), F.col("name").alias(name))


def credit_by_client(credit_period: DataFrame) -> DataFrame:
    """One credit record per client: the one with the latest payment date."""
    latest = F.max(F.struct("date_of_curr_pmnt", "current_credit_period"))
    return (
        credit_period.groupBy("debtor_no")
        .agg(latest.alias("latest"))
        .select(
            "debtor_no",
            F.col("latest.date_of_curr_pmnt").alias("last_payment_date"),
            F.col("latest.current_credit_period").alias("current_credit_period"),
        )
    )


def _registered(client: DataFrame, *more: str) -> DataFrame:
    return client.select("debtor_no", F.col("name").alias("client_name"), *more)


# ---- outstanding balances ---------------------------------------------------------------


BALANCES = ("bal_6m", "bal_3m", "bal_total")


def _balances(invoice: DataFrame, as_of: date) -> DataFrame:
    """Balance of every invoice, in all and of the last six and three months."""
    balance = F.col("outstanding")

    def since(months: int) -> Column:
        recent = F.col("tran_date") >= F.lit(months_before(as_of, months))
        return F.when(recent, balance).otherwise(F.lit(0).cast("decimal(31,10)"))

    return conform.gross_net_amounts(invoice).select(
        "debtor_no",
        "trans_no",
        F.col("dimension_id").alias("company_id"),
        F.col("dimension2_id").alias("division_id"),
        F.col("dimension3_id").alias("subdivision_id"),
        since(6).alias("bal_6m"),
        since(3).alias("bal_3m"),
        balance.alias("bal_total"),
    )


def _of_critical_clients(balances: DataFrame, tables: Tables, category: int) -> DataFrame:
    """Balances of the clients in a status category, with all names."""
    t = tables
    statuses = (
        t["client_status"]
        .filter(F.col("category") == category)
        .select(F.col("id").alias("status_id"), F.col("client_status").alias("status"))
    )
    critical = (
        _registered(t["client"], F.col("client_status").alias("status_id"))
        .join(statuses, "status_id")
        .join(credit_by_client(t["credit_period"]), "debtor_no")
        .withColumnRenamed("current_credit_period", "credit_period")
        .drop("status_id", "last_payment_date")
    )
    d = t["dimension"]
    return (
        balances.join(critical, "debtor_no")
        .join(_names(d, "company_id", "company"), "company_id", "left")
        .join(_names(d, "division_id", "division"), "division_id", "left")
        .join(_names(d, "subdivision_id", "subdivision"), "subdivision_id", "left")
        .drop("company_id", "division_id", "subdivision_id")
    )


def outstanding_lines(
    tables: Tables, as_of: date, category: int = CRITICAL_CATEGORY
) -> DataFrame:
    """Every invoice of the critical clients with its balances and names."""
    return _of_critical_clients(_balances(tables["invoice"], as_of), tables, category)


def outstanding_by_client(
    tables: Tables, as_of: date, category: int = CRITICAL_CATEGORY
) -> DataFrame:
    """R2: the lines of R1 per client with a six-month balance, largest first; its sub-divisions by division.

    The invoices are added up per client, company, division and sub-division before they meet
    the clients: a client with a third of all invoices enters the join as a few rows.

    `divisions` is a map of names, `division_text` the same as sorted text. The sets hold
    dimension names, so their size is that of the dimension table, not of the invoices.
    """
    sums = [F.sum(b).alias(b) for b in BALANCES]
    reduced = (
        _balances(tables["invoice"], as_of)
        .groupBy("debtor_no", "company_id", "division_id", "subdivision_id")
        .agg(*sums)
    )
    lines = _of_critical_clients(reduced, tables, category)
    by_division = lines.groupBy(
        "debtor_no", "client_name", F.coalesce("division", F.lit("No Division")).alias("division")
    ).agg(
        F.min("status").alias("status"),
        F.min("company").alias("company"),
        F.min("credit_period").alias("credit_period"),
        *sums,
        F.collect_set(F.coalesce("subdivision", F.lit("No Subdiv"))).alias("subdivisions"),
    )
    entry = F.struct("division", F.sort_array("subdivisions").alias("subdivisions"))
    entries = F.sort_array(F.collect_list(entry))
    text = F.array_join(
        F.transform(
            F.col("entries"),
            lambda e: F.concat(e["division"], F.lit(": "), F.array_join(e["subdivisions"], ", ")),
        ),
        "; ",
    )
    return (
        by_division.groupBy("debtor_no", "client_name")
        .agg(
            F.min("status").alias("status"),
            F.min("company").alias("company"),
            F.coalesce(F.min("credit_period"), F.lit(0)).alias("credit_period"),
            *sums,
            entries.alias("entries"),
        )
        .filter(F.col("bal_6m") > 0)
        .withColumns({"divisions": F.map_from_entries("entries"), "division_text": text})
        .drop("entries")
        .withColumns({b: report_money(F.col(b)) for b in BALANCES})
        .orderBy(F.col("bal_6m").desc(), "debtor_no")
    )


def outstanding_with_total(by_client: DataFrame) -> DataFrame:
    """The same rows and a grand-total line, marked by `is_total`."""
    client = F.grouping("debtor_no")

    def shown(name: str) -> Column:
        return F.when(client == 0, F.min(name)).alias(name)

    return (
        by_client.rollup("debtor_no")
        .agg(
            client.cast("int").alias("is_total"),
            shown("client_name"),
            shown("status"),
            shown("company"),
            shown("credit_period"),
            *[
                report_money(F.sum(F.col(b).cast("decimal(28,4)"))).alias(b) for b in BALANCES
            ],
            shown("division_text"),
        )
    )


# ---- payments against jobs --------------------------------------------------------------


def _month_number(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def payment_job_latency(tables: Tables, min_months: int = 3) -> DataFrame:
    """Calendar months from a client's last payment to its last job in each division, most first."""
    t = tables
    months = _month_number(F.col("last_job_date")) - _month_number(F.col("last_payment_date"))
    return (
        conform.last_activity_by_division(t["client_activity"])
        .join(
            credit_by_client(t["credit_period"]).filter(F.col("last_payment_date").isNotNull()),
            "debtor_no",
        )
        .withColumn("months_diff", months)
        .filter(F.col("months_diff") >= min_months)
        .join(_registered(t["client"]), "debtor_no")
        .join(_names(t["dimension"], "division", "division_name"), "division")
        .select(
            "debtor_no", "client_name", "division_name", "last_payment_date", "last_job_date",
            "months_diff",
        )
        .orderBy(F.col("months_diff").desc(), "debtor_no", "division_name")
    )


def latency_buckets(latency: DataFrame) -> DataFrame:
    """3-6 months, 6-12 months (both ends included), more than 12 months."""
    m = F.col("months_diff")
    return latency.withColumn(
        "bucket",
        F.when((m >= 3) & (m < 6), "3-6 months")
        .when((m >= 6) & (m <= 12), "6-12 months")
        .when(m > 12, "over 12 months"),
    )


# ---- weekly dashboard -------------------------------------------------------------------


def last_days(as_of: date, days: int = 8) -> tuple[date, date]:
    return as_of - timedelta(days=days), as_of


def _local(
    enquiry: DataFrame, start: date, end: date, location: int | None, names: Mapping[int, str]
) -> DataFrame:
    local = enquiry if location is None else enquiry.filter(F.col("location_country") == location)
    return between_dates(local, "enquiry_date", start, end).withColumns(
        {
            "div_group": division_group(F.col("division"), names),
            "amount": conform.amount(F.col("aprox_amount"), F.col("rate")),
        }
    )


def weekly_division_summary(
    enquiry: DataFrame,
    start: date,
    end: date,
    location: int | None = 1,
    threshold: float = HIGH_VALUE,
    names: Mapping[int, str] = DIVISION_NAMES,
) -> DataFrame:
    """Enquiries, amount and number of large ones per division group."""
    return (
        _local(enquiry, start, end, location, names)
        .groupBy("div_group")
        .agg(
            F.count("client_enquiry_id").alias("enquiry_count"),
            report_money(F.sum("amount")).alias("total_amt"),
            F.count_if(F.col("amount") > F.lit(threshold)).alias("over_500k"),
        )
    )


def top_subdivision_per_group(
    enquiry: DataFrame,
    dimension: DataFrame,
    start: date,
    end: date,
    location: int | None = 1,
    names: Mapping[int, str] = DIVISION_NAMES,
) -> DataFrame:
    """The sub-division with most enquiries in each group; the lower id wins a tie.

    Rows are counted per sub-division first, and the winner is a `max_by` over those counts:
    an aggregate, so no group is ever sorted in one task.
    """
    counted = (
        _local(enquiry, start, end, location, names)
        .groupBy("div_group", "subdivision")
        .agg(F.count("client_enquiry_id").alias("n"), F.sum("amount").alias("amount"))
    )
    best = F.max_by(
        F.struct("subdivision", "n", "amount"),
        F.struct("n", (-F.coalesce("subdivision", F.lit(2**31 - 1))).alias("rank")),
    )
    return (
        counted.groupBy("div_group")
        .agg(best.alias("best"))
        .select(
            "div_group",
            F.col("best.subdivision").alias("subdivision"),
            F.col("best.n").alias("enquiry_count"),
            report_money(F.col("best.amount")).alias("sub_amt"),
        )
        .join(_names(dimension, "subdivision", "sub_name"), "subdivision")
    )


def daily_enquiry_series(
    enquiry: DataFrame,
    start: date,
    end: date,
    location: int | None = 1,
    names: Mapping[int, str] = DIVISION_NAMES,
) -> DataFrame:
    """Enquiries per day and division group, by day."""
    return (
        _local(enquiry, start, end, location, names)
        .groupBy("enquiry_date", "div_group")
        .agg(F.count("*").alias("daily_count"))
        .orderBy("enquiry_date", "div_group")
    )


def fill_calendar_gaps(
    series: DataFrame, start: date, end: date, groups: Sequence[str]
) -> DataFrame:
    """Every day of the range for every group, 0 where the series has no row."""
    spark = series.sparkSession
    days = F.sequence(F.lit(start), F.lit(end))
    calendar = (
        spark.range(1)
        .select(F.explode(days).alias("enquiry_date"))
        .select("enquiry_date", F.explode(F.array(*map(F.lit, groups))).alias("div_group"))
    )
    return calendar.join(series, ["enquiry_date", "div_group"], "left").select(
        "enquiry_date", "div_group", F.coalesce("daily_count", F.lit(0)).alias("daily_count")
    )


# ---- idle and inactive clients ----------------------------------------------------------


def idle_improvements(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Clients that were idle in a division before and are not now."""
    keys = ["division_id", "client_ref"]
    return previous.join(current.select(*keys), keys, "left_anti")


def inactive_clients(
    tables: Tables, as_of: date, min_months: int = 12, max_months: int = 36
) -> DataFrame:
    """Clients whose last job in a division lies 12 to 36 months back.

    Business and outstanding totals are one aggregate per client, joined once, in place of
    two sub-queries per row.
    """
    t = tables
    inactive = conform.last_activity_by_division(t["client_activity"]).filter(
        F.col("last_job_date").between(
            F.lit(months_before(as_of, max_months)), F.lit(months_before(as_of, min_months))
        )
    )
    totals = (
        conform.gross_net_amounts(t["invoice"])
        .groupBy("debtor_no")
        .agg(
            report_money(F.sum("gross_amount")).alias("total_business"),
            report_money(F.sum("outstanding")).alias("total_outstanding"),
        )
    )
    clients = _registered(
        t["client"].filter(F.col("client_type") != EXCLUDED_SECTOR),
        F.col("client_status").alias("status_id"),
    )
    return (
        inactive.join(clients, "debtor_no")
        .join(credit_by_client(t["credit_period"]), "debtor_no")
        .join(totals, "debtor_no", "left")
        .join(_names(t["dimension"], "division", "division_name"), "division")
        .select(
            "debtor_no", "client_name", "status_id", F.col("division").alias("division_id"),
            "division_name", "last_job_date", "last_enquiry_date", "current_credit_period",
            "total_business", "total_outstanding",
        )
    )


def recovered_clients(
    tracked: DataFrame, tables: Tables, as_of: date, months: int = 11
) -> DataFrame:
    """Tracked clients with a recent job later than the tracked one.

    The recent jobs are reduced to the latest one per client and division before the join.
    """
    t = tables
    recent = (
        t["client_activity"]
        .filter(F.col("job_date") > F.lit(months_before(as_of, months)))
        .groupBy("debtor_no", F.col("division").alias("division_id"))
        .agg(F.max("job_date").alias("recovered_date"))
    )
    return (
        tracked.select("debtor_no", "division_id", "last_job_date")
        .join(recent, ["debtor_no", "division_id"])
        .filter(F.col("recovered_date") > F.col("last_job_date"))
        .join(_registered(t["client"]), "debtor_no")
        .join(_names(t["dimension"], "division_id", "division_name"), "division_id")
        .select("debtor_no", "client_name", "division_name", "division_id", "recovered_date")
    )


def bucket_by_division_group(
    inactive: DataFrame, names: Mapping[int, str] = DIVISION_NAMES
) -> DataFrame:
    """One row per division group and client, with its latest job and enquiry."""
    group = division_group(F.col("division_id"), names, NON_MARINE_GROUP)
    return inactive.groupBy(group.alias("div_group"), "debtor_no", "client_name").agg(
        F.min("status_id").alias("status_id"),
        F.max("last_job_date").alias("last_job"),
        F.max("last_enquiry_date").alias("last_enq"),
        F.coalesce(F.min("current_credit_period"), F.lit(0)).alias("credit_period"),
        F.coalesce(F.min("total_business"), F.lit(0.0)).alias("biz"),
        F.coalesce(F.min("total_outstanding"), F.lit(0.0)).alias("out"),
    )


def recovered_by_division_group(
    recovered: DataFrame, names: Mapping[int, str] = DIVISION_NAMES
) -> DataFrame:
    """R14 for recovered clients: the same groups, one row per recovered client."""
    group = division_group(F.col("division_id"), names, NON_MARINE_GROUP)
    return recovered.withColumn("div_group", group)


# ---- lost and cancelled enquiries -------------------------------------------------------


def lost_cancelled_enquiries(
    tables: Tables,
    start: date,
    end: date,
    divisions: Iterable[int] = tuple(DIVISION_NAMES),
) -> DataFrame:
    """Cancelled and lost enquiries of registered clients, in detail, by sub-division and day."""
    t = tables
    facts = between_dates(
        t["enquiry"].filter(
            F.col("division").isin(*divisions) & F.col("enq_status").isin(CANCELLED, LOST)
        ),
        "enquiry_date",
        start,
        end,
    ).select(
        "client_enquiry_id",
        "debtor_no",
        F.col("division").alias("division_id"),
        F.col("subdivision").alias("subdivision_id"),
        F.col("client_type").alias("sector_id"),
        "enquiry_date",
        _decode(
            F.col("enq_status"), {k: ENQUIRY_STATUS[k] for k in (CANCELLED, LOST)}, None
        ).alias("status"),
        conform.amount(F.col("aprox_amount"), F.col("rate")).alias("exact_amount"),
    )
    d = t["dimension"]
    sectors = t["client_type"].select(
        F.col("id").alias("sector_id"), F.col("client_type").alias("sector")
    )
    return (
        facts.join(_registered(t["client"]), "debtor_no")
        .join(_names(d, "division_id", "division_name"), "division_id")
        .join(_names(d, "subdivision_id", "subdivision_name"), "subdivision_id")
        .join(sectors, "sector_id")
        .select(
            "client_enquiry_id", "client_name", "division_id", "division_name",
            "subdivision_name", "enquiry_date", "sector", "status", "exact_amount",
        )
        .orderBy("subdivision_name", "enquiry_date", "client_enquiry_id")
    )


def with_subtotals(detail: DataFrame) -> DataFrame:
    """Subtotal per sub-division and total per division of R15."""
    level = F.when(F.grouping("subdivision_name") == 1, "total").otherwise("subtotal")
    return (
        detail.rollup("division_id", "subdivision_name")
        .agg(
            level.alias("level"),
            F.count("*").alias("enquiries"),
            report_money(F.sum("exact_amount")).alias("amount"),
        )
        .filter(F.col("division_id").isNotNull())
    )


def monthly_loss_trend(
    enquiry: DataFrame,
    as_of: date,
    months: int = 6,
    divisions: Iterable[int] = tuple(DIVISION_NAMES),
) -> DataFrame:
    """Lost and cancelled enquiries by month and division, by month."""
    recent = between_dates(
        enquiry.filter(F.col("division").isin(*divisions)),
        "enquiry_date",
        months_before(as_of, months),
    )
    status = F.col("enq_status")
    by_month = recent.groupBy(F.date_format("enquiry_date", "yyyy-MM").alias("month"), "division")
    return by_month.agg(
        F.count_if(status == LOST).alias("lost_count"),
        F.count_if(status == CANCELLED).alias("cancel_count"),
    ).orderBy("month", "division")


def loss_trend_pivot(
    trend: DataFrame, divisions: Sequence[int] = tuple(DIVISION_NAMES)
) -> DataFrame:
    """Months as rows, one lost and one cancelled column per division, 0 where none.

    The divisions are given, so the pivot needs no job to find them.
    """
    return (
        trend.groupBy("month")
        .pivot("division", list(divisions))
        .agg(F.first("lost_count").alias("lost"), F.first("cancel_count").alias("cancel"))
        .fillna(0)
    )


# ---- revenue ----------------------------------------------------------------------------


def _month(day: date) -> tuple[date, date]:
    first = day.replace(day=1)
    return first, months_before(first, -1) - timedelta(days=1)


def _revenue(
    tables: Tables, start: date, end: date, payment_type: int, sums: Mapping[str, Column]
) -> DataFrame:
    """Named sums of allocated payments x rate, by division and client.

    Allocations are added up per invoice before they meet the invoices, so the join carries
    one row per paid invoice and is already partitioned by its key.
    """
    t = tables
    paid = (
        between_dates(t["payment_allocation"], "date_alloc", start, end)
        .filter(F.col("trans_type_from") == payment_type)
        .groupBy(
            F.col("trans_no_to").alias("trans_no"), F.col("trans_type_to").alias("trans_type")
        )
        .agg(*[F.sum(value).cast("decimal(24,4)").alias(name) for name, value in sums.items()])
    )
    invoices = t["invoice"].select(
        "trans_no", "trans_type", "debtor_no", F.col("dimension2_id").alias("division_id"),
        conform.exact_rate(F.col("rate")).alias("rate"),
    )
    per_client = (
        paid.join(invoices, ["trans_no", "trans_type"])
        .groupBy("division_id", "debtor_no")
        .agg(*[report_money(F.sum(F.col(name) * F.col("rate"))).alias(name) for name in sums])
    )
    return (
        per_client.join(_registered(t["client"]), "debtor_no")
        .join(_names(t["dimension"], "division_id", "division"), "division_id")
        .select("division", "division_id", "debtor_no", "client_name", *sums)
    )


def monthly_revenue(
    tables: Tables, month: date, payment_type: int = CUSTOMER_PAYMENT
) -> DataFrame:
    """Payments allocated in one calendar month, by division and client."""
    paid = conform.exact_money(F.col("alloc_amount"))
    return _revenue(tables, *_month(month), payment_type, {"revenue": paid})


def revenue_drop(
    previous: DataFrame,
    current: DataFrame,
    min_drop: float = 1.0,
    names: Mapping[int, str] = DIVISION_NAMES,
) -> DataFrame:
    """Clients whose revenue in a division fell by more than `min_drop`.

    `previous` is usually the state that the last run has left.
    """
    keys = ["division_id", "debtor_no"]
    both = previous.withColumnRenamed("revenue", "last_month_revenue").join(
        current.select(*keys, F.col("revenue").alias("current_month_revenue")), keys, "left"
    )
    return _drops(both, min_drop, names)


def revenue_drop_from_payments(
    tables: Tables,
    month: date,
    min_drop: float = 1.0,
    names: Mapping[int, str] = DIVISION_NAMES,
    payment_type: int = CUSTOMER_PAYMENT,
) -> DataFrame:
    """R20 without a state: both months from one pass over payments and invoices."""
    first, last = _month(month)
    day, paid = F.col("date_alloc"), conform.exact_money(F.col("alloc_amount"))
    both = _revenue(
        tables,
        months_before(first, 1),
        last,
        payment_type,
        {
            "last_month_revenue": F.when(day < F.lit(first), paid),
            "current_month_revenue": F.when(day >= F.lit(first), paid),
        },
    )
    return _drops(both.filter(F.col("last_month_revenue").isNotNull()), min_drop, names)


def _drops(both: DataFrame, min_drop: float, names: Mapping[int, str]) -> DataFrame:
    now = F.coalesce("current_month_revenue", F.lit(0.0))
    drop = report_money(
        F.col("last_month_revenue").cast("decimal(28,4)") - now.cast("decimal(28,4)")
    )
    return (
        both.withColumns({"current_month_revenue": now, "revenue_drop": drop})
        .filter(F.col("revenue_drop") > min_drop)
        .withColumns(
            {
                "div_group": division_group(F.col("division_id"), names),
                "drop_percent": safe_percent(
                    F.col("revenue_drop"), F.col("last_month_revenue")
                ),
            }
        )
    )


# ---- high-value enquiries ---------------------------------------------------------------


def high_value_enquiries(
    tables: Tables,
    start: date | None = None,
    end: date | None = None,
    threshold: float = HIGH_VALUE,
) -> DataFrame:
    """Large live enquiries of a day (or a range, or all), decoded and named."""
    t = tables
    registered = (F.col("debtor_no") != 0) & (F.col("branch_code") != 0)
    temporary = F.col("enquiry_temp_id") != 0
    ref = F.when(registered, F.col("debtor_no").cast("bigint")).when(
        temporary, -F.col("enquiry_temp_id").cast("bigint")
    )
    facts = high_value(
        between_dates(t["enquiry"], "enquiry_date", start, end).withColumn(
            "amount", conform.amount(F.col("aprox_amount"), F.col("rate"))
        ),
        threshold,
    ).select(
        "book_no",
        "enquiry_date",
        ref.alias("client_ref"),
        F.col("company").alias("company_id"),
        F.col("division").alias("division_id"),
        F.col("subdivision").alias("subdivision_id"),
        _decode(F.col("enq_type"), ENQUIRY_TYPE).alias("enquiry_type"),
        _decode(F.col("enq_status"), ENQUIRY_STATUS).alias("enquiry_status"),
        report_money(F.col("amount")).alias("amount"),
    )
    directory = conform.client_directory(t["client"], t["temp_client"]).select(
        "client_ref", "client_name", "country_id"
    )
    countries = t["country"].select(
        F.col("id").alias("country_id"), F.col("name").alias("country")
    )
    d = t["dimension"]
    unknown = F.col("client_ref").isNull()
    return (
        facts.join(directory, "client_ref", "left")
        .join(countries, "country_id", "left")
        .join(_names(d, "company_id", "company"), "company_id", "left")
        .join(_names(d, "division_id", "division"), "division_id", "left")
        .join(_names(d, "subdivision_id", "subdivision"), "subdivision_id", "left")
        .select(
            "book_no", "enquiry_date", "company", "division", "subdivision",
            F.when(unknown, "Unknown").otherwise(F.col("client_name")).alias("client"),
            "country", "enquiry_type", "enquiry_status", "amount",
        )
    )
