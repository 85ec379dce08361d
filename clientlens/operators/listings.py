"""Country and client listings, active and idle, with their metric roll-ups.

The roll-ups reduce the facts to one row per client before any name, country or sector is
joined: the fact tables are scanned once with their own filters pushed down, aggregated
map-side, and only those small rows meet the client directory, once per listing. A directory that holds a client or country twice
would double its money; the listing fails then and names it (see `cardinality`).
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientlens.functions import report_money, sql
from clientlens.model import CANCELLED, EXCLUDED_SECTOR, LOST, NO_SLICE, Slice, Windows
from clientlens.operators import conform
from clientlens.operators.cardinality import one_row_each
from clientlens.operators.clean import zero_fill
from clientlens.operators.kpis import client_last_activity, is_idle, last_activity
from clientlens.operators.slices import (
    ENQUIRY_COLUMNS,
    INVOICE_COLUMNS,
    between_dates,
    exclude_other_slice,
    lifecycle_filter,
    slice_by,
)

ENQUIRY_METRICS = (
    "total_enquiry_count", "total_enquiry_amount", "cancel_enquiry_count",
    "cancel_enquiry_amount", "lost_enquiry_count", "lost_enquiry_amount",
)
INVOICE_METRICS = ("total_invoice_count", "total_invoice_amount")
METRICS = ENQUIRY_METRICS + INVOICE_METRICS

# Names a caller may sort by.
SORT_COLUMNS = {
    "enquiry_no": "total_enquiry_count",
    "enquiry_amount": "total_enquiry_amount",
    "jobs": "total_invoice_count",
    "actual_invoice": "total_invoice_amount",
    "lost_enquiry": "lost_enquiry_count",
    "lost_amount": "lost_enquiry_amount",
    "cancel_enquiry": "cancel_enquiry_count",
    "cancel_amount": "cancel_enquiry_amount",
}

CLIENT_COLUMNS = (
    "client_ref", "debtor_no", "client_id", "client_name", "client_type", "client_status",
    "temp_client_id",
)


def _enquiry_measures() -> list[Column]:
    """Counts and exact amounts of enquiries: all, cancelled and lost ones."""
    status, value = F.col("enq_status"), F.col("amount")
    groups = {"total": F.lit(True), "cancel": status == CANCELLED, "lost": status == LOST}
    out = []
    for name, test in groups.items():
        amount = F.coalesce(F.sum(F.when(test, value)), F.lit(0).cast("decimal(38,10)"))
        out += [
            F.count_if(test).alias(f"{name}_enquiry_count"),
            amount.alias(f"{name}_enquiry_amount"),
        ]
    return out


def _invoice_measures() -> list[Column]:
    return [
        F.count("*").alias("total_invoice_count"),
        F.sum("net_amount").alias("total_invoice_amount"),
    ]


def _finish(df: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    return df.withColumns({m: report_money(F.col(m)) for m in metrics if m.endswith("_amount")})


def _add_up(df: DataFrame, metrics: tuple[str, ...], *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in metrics])


def _own_or_other(df: DataFrame, part: Slice, columns: Mapping[str, str], other: bool) -> DataFrame:
    if other:
        return exclude_other_slice(df, part.division, part.subdivision, columns)
    return slice_by(df, part.only("division", "subdivision"), columns)


def _in_place(
    df: DataFrame, directory: DataFrame, key: str, country: DataFrame, region: DataFrame, part: Slice
) -> DataFrame:
    """Reduced rows with country and region of their client, inside the slice's place."""
    placed = df.join(directory, key).filter(F.col("client_type") != EXCLUDED_SECTOR)
    placed = one_row_each(slice_by(placed, part.only("country", "sector")), key, of=conform.DIRECTORY)
    country = one_row_each(country, "id", of="the table of countries")
    return slice_by(conform.attach_country(placed, country, region), part.only("region"))


def enquiry_facts(enquiry: DataFrame) -> DataFrame:
    return enquiry.withColumns(
        {
            "client_ref": conform.client_ref(F.col("debtor_no"), F.col("enquiry_temp_id")),
            "amount": conform.amount(F.col("aprox_amount"), F.col("rate")),
        }
    )


def enquiry_status_rollup(
    tables: Mapping[str, DataFrame],
    by: str,
    part: Slice = NO_SLICE,
    start: date | None = None,
    end: date | None = None,
    other: bool = False,
) -> DataFrame:
    """Number and amount of enquiries, cancelled and lost ones, `by` country or client.

    With `other`, business with the other divisions: see `exclude_other_slice`.
    """
    t = tables
    facts = between_dates(
        _own_or_other(t["enquiry"], part, ENQUIRY_COLUMNS, other), "enquiry_date", start, end
    )
    per_client = (
        enquiry_facts(facts)
        .filter(F.col("client_ref").isNotNull())
        .groupBy("client_ref")
        .agg(*_enquiry_measures())
    )
    directory = conform.client_directory(t["client"], t["temp_client"]).select(
        "client_ref", "country_id", "client_type"
    )
    placed = _in_place(per_client, directory, "client_ref", t["country"], t["region"], part)
    if by == "client":
        return _finish(placed, ENQUIRY_METRICS).select("client_ref", *ENQUIRY_METRICS)
    placed = placed.filter(F.col("country_id").isNotNull())
    summed = _add_up(placed, ENQUIRY_METRICS, "country_id", "country_name", "region_name")
    return _finish(summed, ENQUIRY_METRICS)


def invoice_rollup(
    tables: Mapping[str, DataFrame],
    by: str,
    part: Slice = NO_SLICE,
    start: date | None = None,
    end: date | None = None,
    other: bool = False,
) -> DataFrame:
    """Number and net amount of invoices of clients with known country."""
    t = tables
    facts = between_dates(
        _own_or_other(t["invoice"], part, INVOICE_COLUMNS, other), "tran_date", start, end
    )
    per_client = (
        conform.gross_net_amounts(facts)
        .groupBy(F.col("debtor_no").cast("bigint").alias("client_ref"))
        .agg(*_invoice_measures())
    )
    directory = (
        conform.client_directory(t["client"], t["temp_client"])
        .filter(F.col("client_ref") > 0)
        .filter(F.col("country_id").isNotNull())
        .select("client_ref", "country_id", "client_type")
    )
    placed = _in_place(per_client, directory, "client_ref", t["country"], t["region"], part)
    if by == "client":
        return _finish(placed, INVOICE_METRICS).select("client_ref", *INVOICE_METRICS)
    return _finish(_add_up(placed, INVOICE_METRICS, "country_id"), INVOICE_METRICS)


def _business_facts(
    tables: Mapping[str, DataFrame], part: Slice, start: date | None, end: date | None, other: bool
) -> DataFrame:
    """Enquiries and invoices as one stream of (client, division, status, amount, net).

    Grouped by client, the union costs one shuffle where two facts would cost two.
    """
    enquiries = between_dates(
        _own_or_other(tables["enquiry"], part, ENQUIRY_COLUMNS, other), "enquiry_date", start, end
    )
    invoices = between_dates(
        _own_or_other(tables["invoice"], part, INVOICE_COLUMNS, other), "tran_date", start, end
    )
    asked = enquiry_facts(enquiries).select(
        "client_ref", F.col("division").cast("int"), "enq_status", "amount",
        F.lit(None).cast("decimal(32,10)").alias("net_amount"),
        F.lit(False).alias("is_invoice"),
    )
    billed = conform.gross_net_amounts(invoices).select(
        conform.client_ref(F.col("debtor_no"), F.lit(None).cast("bigint")).alias("client_ref"),
        F.col("dimension2_id").cast("int").alias("division"),
        F.lit(None).cast("int").alias("enq_status"),
        F.lit(None).cast("decimal(31,10)").alias("amount"),
        F.col("net_amount").cast("decimal(32,10)").alias("net_amount"),
        F.lit(True).alias("is_invoice"),
    )
    return asked.unionByName(billed).filter(F.col("client_ref").isNotNull())


def _business_measures(where: str = "true", suffix: str = "") -> list[Column]:
    """All metrics over `_business_facts`; null where a client has no row of that kind."""
    groups = {
        "total_enquiry": ("NOT is_invoice", "true", "amount"),
        "cancel_enquiry": ("NOT is_invoice", f"enq_status = {CANCELLED}", "amount"),
        "lost_enquiry": ("NOT is_invoice", f"enq_status = {LOST}", "amount"),
        "total_invoice": ("is_invoice", "true", "net_amount"),
    }
    out = []
    for name, (kind, test, value) in groups.items():
        for metric, shown in (("count", "1"), ("amount", value)):
            cases = f"WHEN {kind} AND {where} AND {test} THEN {shown} WHEN {kind} AND {where} THEN 0"
            out.append(F.expr(f"sum(CASE {cases} END)").alias(f"{name}_{metric}{suffix}"))
    return out


def client_business(
    tables: Mapping[str, DataFrame],
    part: Slice = NO_SLICE,
    start: date | None = None,
    end: date | None = None,
    other: bool = False,
) -> DataFrame:
    """Exact enquiry and invoice metrics per client, in one pass; nothing joined yet."""
    facts = _business_facts(tables, part, start, end, other)
    return facts.groupBy("client_ref").agg(*_business_measures())


def _country_business(
    tables: Mapping[str, DataFrame],
    part: Slice,
    start: date | None,
    end: date | None,
    other: bool = False,
) -> DataFrame:
    """The same metrics added up per country: L5 and L6 together, one directory join."""
    t = tables
    directory = conform.client_directory(t["client"], t["temp_client"]).select(
        "client_ref", "country_id", "client_type"
    )
    per_client = client_business(t, part, start, end, other)
    placed = _in_place(per_client, directory, "client_ref", t["country"], t["region"], part)
    known = placed.filter(F.col("country_id").isNotNull())
    return _finish(_add_up(known, METRICS, "country_id"), METRICS)


def _masked(metric: str, where: str) -> str:
    """A metric where a condition holds, money as reports show it."""
    value = f"CASE WHEN {where} THEN {metric} END"
    if metric.endswith("_amount"):
        return f"CAST(CAST({value} AS DECIMAL(38,4)) AS DOUBLE)"
    return value


def _with_business(
    clients: DataFrame, business: DataFrame, tables: Mapping[str, DataFrame], part: Slice, *keys: str
) -> DataFrame:
    """Clients with their metrics, where the client's home is inside the slice.

    The home country and sector came along with the client's name, so the directory is joined
    once per listing. Clients of the excluded sector have no metrics, and invoices also need
    a known country.
    """
    joined = clients.join(business, ["client_ref", *keys], "left")
    counted = F.col("home_sector") != EXCLUDED_SECTOR
    if part.sector is not None:
        counted = counted & (F.col("home_sector") == part.sector)
    if part.country is not None:
        counted = counted & (F.col("home_country") == part.country)
    if part.region is not None:
        regions = tables["country"].select(
            F.col("id").alias("home_country"), F.col("region_id").alias("home_region")
        )
        joined = joined.join(regions, "home_country", "left")
        counted = counted & (F.col("home_region") == part.region)
    placed = counted & F.col("home_country").isNotNull()
    finished = joined.withColumns({"_counted": counted, "_placed": placed}).withColumns(
        {
            m: F.expr(_masked(m, "_counted" if m in ENQUIRY_METRICS else "_placed"))
            for m in METRICS
        }
    )
    return conform.with_sector_names(finished, tables["client_type"])


def _one_row_a_country(listing: DataFrame) -> DataFrame:
    return one_row_each(listing, "country_id", of="the table of countries")


def sort_by_name(
    df: DataFrame,
    name: str | None,
    descending: bool = True,
    tie: str = "country_id",
    default: str = "total_enquiry_amount",
) -> DataFrame:
    """Order by a whitelisted name, nulls last, with an ascending tie-breaker."""
    return df.orderBy(*sort_keys(df, name, descending, tie, default))


def sort_keys(
    df: DataFrame,
    name: str | None,
    descending: bool = True,
    tie: str = "country_id",
    default: str = "total_enquiry_amount",
) -> list[Column]:
    """The keys of `sort_by_name`, as `numbered` needs them to number the rows in this order."""
    column = SORT_COLUMNS.get(name or "", default)
    if column not in df.columns:
        column = default
    value = F.col(column)
    order = value.desc_nulls_last() if descending else value.asc_nulls_last()
    return [order, F.col(tie).asc_nulls_last()]


def _default_sort(kind: str | None) -> str:
    return "total_invoice_amount" if kind and "job" in kind else "total_enquiry_amount"


def listed_countries(
    tables: Mapping[str, DataFrame], w: Windows, kind: str | None = None, part: Slice = NO_SLICE
) -> DataFrame:
    """The countries of L1, without metrics."""
    t = tables
    found = conform.country_activity(t["client_activity"], t["country"], t["region"], part)
    return lifecycle_filter(found, kind, w)


def listed_clients(
    tables: Mapping[str, DataFrame], w: Windows, kind: str | None = None, part: Slice = NO_SLICE
) -> DataFrame:
    """The clients of L3, without metrics."""
    last = conform.client_last(tables["client_activity"], w, part)
    named = conform.with_directory(last, tables["client"], tables["temp_client"])
    return lifecycle_filter(named, kind, w)


def country_listing(
    tables: Mapping[str, DataFrame],
    w: Windows,
    kind: str | None = None,
    part: Slice = NO_SLICE,
    start: date | None = None,
    end: date | None = None,
    order_by: str | None = None,
    descending: bool = True,
) -> DataFrame:
    """L1: countries of a lifecycle segment with their enquiry and invoice metrics."""
    listing = listed_countries(tables, w, kind, part).join(
        _country_business(tables, part, start, end), "country_id", "left"
    )
    listing = _one_row_a_country(listing)
    ordered = sort_by_name(listing, order_by, descending, default=_default_sort(kind))
    return zero_fill(ordered.select("country_id", "country_name", "region_name", *METRICS))


def idle_country_listing(
    tables: Mapping[str, DataFrame],
    w: Windows,
    kind: str = "idle_enq",
    part: Slice = NO_SLICE,
    start: date | None = None,
    end: date | None = None,
    order_by: str | None = None,
    descending: bool = True,
) -> DataFrame:
    """L2: countries with history but none in the slice, and their business elsewhere."""
    t = tables
    last = last_activity(
        t["client_activity"],
        "country_id",
        part.only("country", "region", "sector"),
        part.only("division", "subdivision"),
    )
    idle = last.filter(is_idle("job" if kind == "idle_job" else "enquiry", w)).select("country_id")
    named = conform.attach_country(idle, t["country"], t["region"])
    elsewhere = _country_business(t, part, start, end, other=True)
    listing = named.join(elsewhere, "country_id", "left")
    listing = _one_row_a_country(listing)
    ordered = sort_by_name(listing, order_by, descending, default=_default_sort(kind))
    return zero_fill(ordered.select("country_id", "country_name", "region_name", *METRICS))


def client_listing(
    tables: Mapping[str, DataFrame],
    w: Windows,
    kind: str | None = None,
    part: Slice = NO_SLICE,
    start: date | None = None,
    end: date | None = None,
    order_by: str | None = None,
    descending: bool = True,
) -> DataFrame:
    """L3: clients of a lifecycle segment with their enquiry and invoice metrics."""
    clients = listed_clients(tables, w, kind, part)
    business = client_business(tables, part, start, end)
    listing = _with_business(clients, business, tables, part)
    ordered = sort_by_name(listing, order_by, descending, tie="client_ref")
    return zero_fill(ordered.select(*CLIENT_COLUMNS, *METRICS))


def idle_clients(
    tables: Mapping[str, DataFrame], w: Windows, kind: str = "idle_enq", part: Slice = NO_SLICE
) -> DataFrame:
    """Registered clients with history anywhere, but none in the slice."""
    last = client_last_activity(tables["client_activity"], w, NO_SLICE, part)
    return last.filter("client_ref > 0").filter(
        is_idle("job" if kind == "idle_job" else "enquiry", w)
    )


def idle_client_listing(
    tables: Mapping[str, DataFrame],
    w: Windows,
    kind: str = "idle_enq",
    part: Slice = NO_SLICE,
    order_by: str | None = None,
    descending: bool = True,
) -> DataFrame:
    """L4: registered clients idle in the slice, and their business with other divisions."""
    t = tables
    idle = idle_clients(t, w, kind, part)
    named = conform.with_directory(idle, t["client"], t["temp_client"])
    listing = _with_business(named, client_business(t, part, other=True), t, part)
    ordered = sort_by_name(listing, order_by, descending, tie="client_ref")
    return zero_fill(ordered.select(*CLIENT_COLUMNS, *METRICS))


def listing_count(listing: DataFrame) -> DataFrame:
    """Number of entities: distinct countries, or registered plus temporary clients.

    Give it the listed entities: there is no need to compute the metrics to count them.
    """
    key = "client_ref" if "client_ref" in listing.columns else "country_id"
    return listing.agg(F.count_distinct(key).alias("entities"))


def _per_division(divisions: tuple[int, ...], *fields: str) -> Column:
    """Array of one struct per division, from columns that carry the division as suffix."""
    return F.array(
        *[
            F.struct(
                F.lit(d).alias("division_id"), *[F.col(f"{f}_{d}").alias(f) for f in fields]
            )
            for d in divisions
        ]
    )


def idle_in_divisions(
    tables: Mapping[str, DataFrame],
    w: Windows,
    divisions: tuple[int, ...],
    kind: str = "idle_enq",
) -> DataFrame:
    """Rows (client_ref, sector_id, division_id): who is idle in which of the divisions.

    The activity is scanned once: every division has its own conditional aggregate, and the
    rows fan out after the aggregation.
    """
    day = "job_date" if kind == "idle_job" else "enquiry_date"
    recent = tables["client_activity"].filter(
        (F.col("country_id") > 0)
        & (F.col("client_type") != EXCLUDED_SECTOR)
        & (F.col("enquiry_date") >= F.lit(w.floor))
        & (F.col("debtor_no") > 0)
    )
    last = recent.groupBy(F.col("debtor_no").cast("bigint").alias("client_ref")).agg(
        F.min("client_type").alias("sector_id"),
        F.max(day).alias("last_all"),
        *[F.max(F.when(F.col("division") == d, F.col(day))).alias(f"last_{d}") for d in divisions],
    )
    return (
        last.filter(F.col("last_all") > F.lit(w.floor))
        .select("client_ref", "sector_id", F.inline(_per_division(divisions, "last")))
        .filter(~F.coalesce(F.col("last") > F.lit(w.floor), F.lit(False)))
        .drop("last")
    )


def idle_snapshot_all_divisions(
    tables: Mapping[str, DataFrame],
    w: Windows,
    divisions: tuple[int, ...],
    kind: str = "idle_enq",
) -> DataFrame:
    """The idle listing of several divisions, tagged with the division.

    Equal to one L4 per division put together, with each fact table scanned once.
    """
    t = tables
    idle = idle_in_divisions(t, w, divisions, kind)
    named = conform.with_directory(idle, t["client"], t["temp_client"], ("client_ref", "division_id"))
    business = (
        _business_facts(t, NO_SLICE, None, None, other=False)
        .filter(F.col("client_ref") > 0)
        .groupBy("client_ref")
        .agg(*[m for d in divisions for m in _business_measures(f"division != {sql.ids([d])}", f"_{d}")])
        .select("client_ref", F.inline(_per_division(divisions, *METRICS)))
    )
    listing = _with_business(named, business, t, NO_SLICE, "division_id")
    return zero_fill(listing.select("division_id", *CLIENT_COLUMNS, *METRICS))
