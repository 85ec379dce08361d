"""Lifecycle counts, growth and shares.

Every figure is a conditional aggregate. Amounts come from one pass over the fact table: the
pass reduces it to one row per division and sector ("totals"), and growth, shares and sector
figures are read off that small frame. Counts come from one row per entity, so a plain
`count_if` replaces several distinct counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientlens.functions import report_money, safe_percent, sql
from clientlens.model import (
    BLACKLISTED_STATUS,
    CLOSED_STATUS,
    DIVISION_NAMES,
    EXCLUDED_SECTOR,
    NO_SLICE,
    NON_MARINE_GROUP,
    SECTORS,
    Slice,
    TRANSFERRED,
    Windows,
)
from clientlens.operators.conform import amount, client_ref, gross_net_amounts
from clientlens.operators.slices import (
    ENQUIRY_COLUMNS,
    INVOICE_COLUMNS,
    between_dates,
    has_history,
    inside,
    is_active,
    is_inactive,
    is_lost,
    slice_by,
)


def _sum_if(condition: str, value: str, name: str) -> Column:
    """An exact conditional sum; 0 and not null where no row qualifies."""
    return F.expr(f"coalesce(sum(CASE WHEN {condition} THEN {value} END), 0)").alias(name)


def counts(**predicates: str) -> list[Column]:
    return [F.expr(f"count_if({test})").alias(name) for name, test in predicates.items()]


def lifecycle(day: str, w: Windows, prefix: str, where: str = "true") -> list[Column]:
    tests = {"total": has_history, "active": is_active, "inactive": is_inactive, "lost": is_lost}
    return counts(**{f"{prefix}_{n}": f"{where} AND {test(day, w)}" for n, test in tests.items()})


# ---- counts -----------------------------------------------------------------------------


def country_lifecycle_counts(countries: DataFrame, w: Windows) -> DataFrame:
    """K1, from `country_activity`."""
    return countries.agg(
        F.count("*").alias("countries"),
        *lifecycle("enquiry_date", w, "enquiry"),
        *lifecycle("job_date", w, "job"),
    )


def client_lifecycle_counts(clients: DataFrame, w: Windows) -> DataFrame:
    """K2, from `client_activity`: registered and temporary clients are counted alike."""
    return clients.filter(has_history("enquiry_date", w)).agg(
        *lifecycle("enquiry_date", w, "enquiry"),
        *lifecycle("job_date", w, "job"),
    )


def activity_code_lifecycle_counts(codes: DataFrame, w: Windows) -> DataFrame:
    """K3, from `activity_code_summary`; codes without an enquiry since the floor are out."""
    return codes.filter(F.col("enquiry_date") >= F.lit(w.floor)).agg(
        *lifecycle("enquiry_date", w, "enquiry"),
        *lifecycle("job_date", w, "job"),
    )


def status_counts(
    enquiry: str, job: str, w: Windows, blacklisted: Iterable[int], closed: Iterable[int]
) -> list[Column]:
    with_enquiry = has_history(enquiry, w)
    with_job = f"{with_enquiry} AND {has_history(job, w)}"
    black = f"status_id IN ({sql.ids(blacklisted)})"
    shut = f"status_id IN ({sql.ids(closed)})"
    return counts(
        enquiry_blacklisted=f"{black} AND {with_enquiry}",
        enquiry_closed=f"{shut} AND {with_enquiry}",
        job_blacklisted=f"{black} AND {with_job}",
        job_closed=f"{shut} AND {with_job}",
    )


def client_status_counts(
    clients: DataFrame,
    w: Windows,
    blacklisted: Iterable[int] = BLACKLISTED_STATUS,
    closed: Iterable[int] = CLOSED_STATUS,
) -> DataFrame:
    """K4, from `client_activity`."""
    return clients.agg(*status_counts("enquiry_date", "job_date", w, blacklisted, closed))


def live_activity(activity: DataFrame) -> DataFrame:
    """Activity with a country, outside the excluded sector."""
    return activity.filter((F.col("country_id") > 0) & (F.col("client_type") != EXCLUDED_SECTOR))


def last_activity(activity: DataFrame, key: str, within: Slice, here: Slice) -> DataFrame:
    """Last enquiry and job per key, both anywhere in `within` and in the part of it `here`.

    One aggregate gives both sides of the idle question, where an anti join would scan and
    shuffle the activity twice. Keys that are null are left out.
    """
    history = slice_by(live_activity(activity), within).filter(F.col(key).isNotNull())
    seen = inside(here)
    return history.groupBy(key).agg(
        F.max("enquiry_date").alias("enquiry_all"),
        F.expr(f"max(IF({seen}, enquiry_date, NULL))").alias("enquiry_here"),
        F.max("job_date").alias("job_all"),
        F.expr(f"max(IF({seen}, job_date, NULL))").alias("job_here"),
        F.expr(f"max({seen})").alias("seen_here"),
        F.min("client_type").alias("sector_id"),
    )


def _around(part: Slice) -> tuple[Slice, Slice]:
    """History is taken within a slice's place and sector; idleness is about its divisions."""
    return part.only("country", "region", "sector"), part.only("division", "subdivision")


def is_idle(kind: str, w: Windows) -> str:
    """On a row of `last_activity`: history since the floor, but none of it in the slice."""
    anywhere, present = has_history(f"{kind}_all", w), has_history(f"{kind}_here", w)
    return f"(coalesce({anywhere}, false) AND NOT coalesce({present}, false))"


def client_last_activity(
    activity: DataFrame, w: Windows, within: Slice, here: Slice
) -> DataFrame:
    """`last_activity` per client, from the rows that have an enquiry since the floor."""
    recent = activity.filter(F.col("enquiry_date") >= F.lit(w.floor)).withColumn(
        "client_ref", client_ref(F.col("debtor_no"), F.col("temp_client_id"))
    )
    return last_activity(recent, "client_ref", within, here)


def idle_counts(activity: DataFrame, w: Windows, part: Slice) -> DataFrame:
    """Idle countries and idle registered clients, as rows (entity, enquiry, job)."""
    idle = counts(idle_enquiry=is_idle("enquiry", w), idle_job=is_idle("job", w))
    countries = last_activity(activity, "country_id", *_around(part)).agg(*idle)
    clients = client_last_activity(activity, w, *_around(part)).filter("client_ref > 0").agg(*idle)
    return countries.select(F.lit("countries").alias("entity"), "*").unionByName(
        clients.select(F.lit("clients").alias("entity"), "*")
    )


def country_board(activity: DataFrame, w: Windows, part: Slice = NO_SLICE) -> DataFrame:
    """K1 and the country half of K11 as one row, from one scan of the activity."""
    return last_activity(activity, "country_id", *_around(part)).agg(
        *counts(countries="seen_here"),
        *lifecycle("enquiry_here", w, "enquiry"),
        *lifecycle("job_here", w, "job"),
        *counts(idle_enquiry=is_idle("enquiry", w), idle_job=is_idle("job", w)),
    )


def client_board(
    activity: DataFrame, client: DataFrame, w: Windows, part: Slice = NO_SLICE
) -> DataFrame:
    """K2, K4 and the client half of K11 as one row, from one scan of the activity."""
    statuses = client.select(
        F.col("debtor_no").cast("bigint").alias("client_ref"),
        F.col("client_status").cast("int").alias("status_id"),
    )
    since = has_history("enquiry_here", w)
    return (
        client_last_activity(activity, w, *_around(part))
        .join(statuses, "client_ref", "left")
        .agg(
            *lifecycle("enquiry_here", w, "enquiry", since),
            *lifecycle("job_here", w, "job", since),
            *status_counts("enquiry_here", "job_here", w, BLACKLISTED_STATUS, CLOSED_STATUS),
            *counts(
                idle_enquiry=f"client_ref > 0 AND {is_idle('enquiry', w)}",
                idle_job=f"client_ref > 0 AND {is_idle('job', w)}",
            ),
        )
    )


# ---- amounts: one pass per fact table ---------------------------------------------------


def _place(
    df: DataFrame, client: DataFrame, country: DataFrame, part: Slice, sector: bool
) -> DataFrame:
    """Join what the slice needs of the client onto rows already reduced to `debtor_no`."""
    known = client.select(
        F.col("debtor_no").cast("bigint").alias("debtor_no"),
        F.col("country").cast("int").alias("country_id"),
        *([F.col("client_type").cast("int").alias("client_type")] if sector else []),
    )
    placed = df.join(known, "debtor_no", "left")
    if part.region is not None:
        regions = country.select(F.col("id").alias("country_id"), "region_id")
        placed = placed.join(regions, "country_id", "left")
    return placed


def enquiry_sums(enquiry: DataFrame, w: Windows, *keys: Column | str) -> DataFrame:
    """Amounts of the three periods of `enquiry_totals`, by some keys."""
    day, status = F.col("enquiry_date"), F.coalesce(F.col("enq_status"), F.lit(0))
    kept = status != TRANSFERRED
    value = amount(F.col("aprox_amount"), F.col("rate"))
    previous = (day >= F.lit(w.previous_from)) & (day < F.lit(w.inactive_to))
    current = (day > F.lit(w.active_from)) & (day < F.lit(w.active_to))
    facts = between_dates(enquiry, "enquiry_date", w.previous_from, w.active_to)
    return facts.groupBy(*keys).agg(
        F.sum(F.when(previous & kept, value)).alias("previous"),
        F.sum(F.when(current & kept, value)).alias("current"),
        F.sum(F.when(F.expr(is_active("enquiry_date", w)), value)).alias("active"),
    )


def invoice_sums(invoice: DataFrame, w: Windows, *keys: Column | str) -> DataFrame:
    """Amounts of the two periods of `invoice_totals`, by some keys."""
    day = F.col("tran_date")
    previous = day.between(F.lit(w.previous_job_from), F.lit(w.previous_job_to))
    current = day.between(F.lit(w.job_from), F.lit(w.job_to))
    facts = gross_net_amounts(between_dates(invoice, "tran_date", w.previous_job_from, w.job_to))
    net, gross = F.col("net_amount"), F.col("gross_amount")
    return facts.groupBy(*keys).agg(
        F.sum(F.when(previous, net)).alias("previous_net"),
        F.sum(F.when(current, net)).alias("current_net"),
        F.sum(F.when(previous, gross)).alias("previous_gross"),
        F.sum(F.when(current, gross)).alias("current_gross"),
    )


def enquiry_totals(
    enquiry: DataFrame,
    client: DataFrame,
    country: DataFrame,
    w: Windows,
    part: Slice = NO_SLICE,
) -> DataFrame:
    """Enquiry amounts per division and sector: previous, current and active period.

    `previous` and `current` leave transfers out and keep their own bounds; `active` is the
    active window with transfers. The sector is the enquiry's own; country and region are
    those of the registered client.
    """
    facts = slice_by(enquiry, part.only("division", "subdivision", "sector"), ENQUIRY_COLUMNS)
    located = part.country is not None or part.region is not None
    keys = (["debtor_no"] if located else []) + ["division", "client_type"]
    sums = enquiry_sums(facts, w, *keys)
    if not located:
        return sums
    placed = slice_by(
        _place(sums, client, country, part, sector=False), part.only("country", "region")
    )
    return _regroup(placed, ["previous", "current", "active"])


def invoice_totals(
    invoice: DataFrame,
    client: DataFrame,
    country: DataFrame,
    w: Windows,
    part: Slice = NO_SLICE,
) -> DataFrame:
    """Net and gross invoice amounts per division and sector, previous and current period."""
    facts = slice_by(invoice, part.only("division", "subdivision"), INVOICE_COLUMNS)
    sums = invoice_sums(facts, w, "debtor_no", F.col("dimension2_id").alias("division"))
    placed = _place(sums, client, country, part, sector=True).filter(
        F.col("client_type") != EXCLUDED_SECTOR
    )
    placed = slice_by(placed, part.only("country", "region", "sector"))
    return _regroup(placed, ["previous_net", "current_net", "previous_gross", "current_gross"])


def _regroup(df: DataFrame, amounts: list[str]) -> DataFrame:
    return df.groupBy("division", "client_type").agg(*[F.sum(a).alias(a) for a in amounts])


# A group of figures is a pair: the aggregates it needs, and named columns over them. Standing
# alone it is one `agg` and one `select`; the board joins many into a single `agg`.
Figures = tuple[list[Column], dict[str, Column]]


def figures_row(totals: DataFrame, *groups: Figures) -> DataFrame:
    """One row with the figures of all groups, from one aggregate over the totals."""
    sums = totals.agg(*[a for aggregates, _ in groups for a in aggregates])
    return sums.select(*[c.alias(name) for _, named in groups for name, c in named.items()])


def _growth(name: str, previous: str, current: str, precision: int) -> Figures:
    sums = [
        _sum_if("true", previous, f"{name}_sum_previous"),
        _sum_if("true", current, f"{name}_sum_current"),
    ]
    # the growth is that of the amounts as shown, to four decimals
    before = F.col(f"{name}_sum_previous").cast("decimal(30,4)")
    now = F.col(f"{name}_sum_current").cast("decimal(30,4)")
    growth = report_money(now - before)
    return sums, {
        f"{name}_previous": report_money(before),
        f"{name}_current": report_money(now),
        f"{name}_growth": growth,
        f"{name}_growth_percent": safe_percent(growth, report_money(before), precision),
    }


def enquiry_growth_figures(precision: int = 1) -> Figures:
    return _growth("enquiry", "previous", "current", precision)


def invoice_growth_figures(precision: int = 2) -> Figures:
    net = _growth("net", "previous_net", "current_net", precision)
    gross = _growth("gross", "previous_gross", "current_gross", precision)
    return net[0] + gross[0], {**net[1], **gross[1]}


def enquiry_growth(totals: DataFrame, precision: int = 1) -> DataFrame:
    """K5, from `enquiry_totals`."""
    return figures_row(totals, enquiry_growth_figures(precision))


def invoice_growth(totals: DataFrame, precision: int = 2) -> DataFrame:
    """K6, from `invoice_totals`."""
    return figures_row(totals, invoice_growth_figures(precision))


def _shares(prefix: str, value: str, total: str, groups: Mapping[str, str]) -> Figures:
    sums = [_sum_if("true", total, f"{prefix}_sum_total")]
    named = {}
    for group, test in groups.items():
        sums.append(_sum_if(test, value, f"{prefix}_sum_{group}"))
        part = report_money(F.col(sql.name(f"{prefix}_sum_{group}")))
        whole = report_money(F.col(f"{prefix}_sum_total"))
        named[f"{prefix}_{group}_amount"] = part
        named[f"{prefix}_{group}_percent"] = safe_percent(part, whole)
    return sums, named


def enquiry_share_figures(
    divisions: Mapping[int, str] = DIVISION_NAMES, include_transfers: bool = True, source: str | None = None
) -> Figures:
    """`source`: the column that is shared out, where it is neither of the two that `include_transfers` chooses from."""
    source = source or ("active" if include_transfers else "current")
    groups = {
        name: f"division = {sql.ids([number])} AND client_type != {EXCLUDED_SECTOR}"
        for number, name in divisions.items()
    }
    return _shares("enquiry", source, "current", groups)


def invoice_share_figures(
    divisions: Mapping[int, str] = DIVISION_NAMES, non_marine: Iterable[int] | None = None
) -> Figures:
    groups = {name: f"division = {sql.ids([number])}" for number, name in divisions.items()}
    if non_marine is None:
        groups[NON_MARINE_GROUP] = f"division NOT IN ({sql.ids(divisions)})"
    else:
        groups[NON_MARINE_GROUP] = f"division IN ({sql.ids(non_marine)})"
    return _shares("invoice", "current_net", "current_net", groups)


def _share_rows(totals: DataFrame, figures: Figures, prefix: str) -> DataFrame:
    """Rows (division_group, amount, percent) of a share group."""
    groups = [n[len(prefix) + 1 : -len("_amount")] for n in figures[1] if n.endswith("_amount")]
    rows = ", ".join(
        f"{sql.text(g)}, {sql.name(f'{prefix}_{g}_amount')}, {sql.name(f'{prefix}_{g}_percent')}"
        for g in groups
    )
    return figures_row(totals, figures).selectExpr(
        f"stack({len(groups)}, {rows}) AS (division_group, amount, percent)"
    )


def enquiry_share_by_division(
    totals: DataFrame,
    divisions: Mapping[int, str] = DIVISION_NAMES,
    include_transfers: bool = True,
) -> DataFrame:
    """K7: active-window amount of chosen divisions, as a share of the current total."""
    return _share_rows(totals, enquiry_share_figures(divisions, include_transfers), "enquiry")


def invoice_share_by_division(
    totals: DataFrame,
    divisions: Mapping[int, str] = DIVISION_NAMES,
    non_marine: Iterable[int] | None = None,
) -> DataFrame:
    """Net amount of chosen divisions and of the non-marine group, as a share.

    Without a list, the non-marine group is every division that is not a chosen one.
    """
    return _share_rows(totals, invoice_share_figures(divisions, non_marine), "invoice")


def sector_figures(
    prefix: str, value: str, sectors: Mapping[int, str] = SECTORS
) -> Figures:
    """One amount per sector as columns, 0 where there is none."""
    sums = [
        _sum_if(f"client_type = {sql.ids([number])}", value, f"{prefix}_sum_{name}")
        for number, name in sectors.items()
    ]
    return sums, {
        f"{prefix}_{name}": report_money(F.col(f"{prefix}_sum_{name}"))
        for name in sectors.values()
    }


def _by_sector(
    totals: DataFrame, value: str, client_type: DataFrame, sectors: Iterable[int]
) -> DataFrame:
    wanted = client_type.filter(F.col("id").isin(*sectors)).select(
        F.col("id").alias("sector_id"), F.col("client_type").alias("sector")
    )
    sums = totals.groupBy(F.col("client_type").alias("sector_id")).agg(F.sum(value).alias("total"))
    return wanted.join(sums, "sector_id", "left").select(
        "sector_id",
        "sector",
        report_money(F.coalesce("total", F.lit(0).cast("decimal(38,4)"))).alias("amount"),
    )


def enquiry_by_sector(
    totals: DataFrame,
    client_type: DataFrame,
    sectors: Iterable[int] = tuple(SECTORS),
    include_transfers: bool = True,
) -> DataFrame:
    """K8: active-window amount of every sector, 0 where there is none."""
    source = "active" if include_transfers else "current"
    return _by_sector(totals, source, client_type, sectors)


def invoice_by_sector(
    totals: DataFrame, client_type: DataFrame, sectors: Iterable[int] = tuple(SECTORS)
) -> DataFrame:
    """K9: net invoice amount of every sector in the current period."""
    return _by_sector(totals, "current_net", client_type, sectors)
