"""The whole KPI board of one slice."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientlens.functions import sql
from clientlens.model import DIVISION_NAMES, NO_SLICE, SECTORS, Slice, Windows
from clientlens.operators import conform, kpis


def _metrics(row: DataFrame, prefix: str) -> DataFrame:
    """One-row frame -> rows (metric, value)."""
    pairs = ", ".join(
        f"{sql.text(f'{prefix}_{column}')}, DOUBLE({sql.name(column)})" for column in row.columns
    )
    return row.selectExpr(f"stack({len(row.columns)}, {pairs}) AS (metric, value)")


def kpi_pieces(
    tables: Mapping[str, DataFrame],
    w: Windows,
    part: Slice = NO_SLICE,
    divisions: Mapping[int, str] = DIVISION_NAMES,
    sectors: Mapping[int, str] = SECTORS,
) -> list[tuple[str, DataFrame]]:
    """The board in pieces: a prefix and one row of figures each.

    Two passes over the client activity (by country, by client) and one over each other fact
    table; every figure of a pass comes out of the same aggregate.

    Sector amounts count transfers; division amounts do so on a company-wide board only.
    """
    t = tables
    transfers = part.is_open()
    enquiries = kpis.enquiry_totals(t["enquiry"], t["client"], t["country"], w, part)
    invoices = kpis.invoice_totals(t["invoice"], t["client"], t["country"], w, part)
    codes = conform.activity_code_summary(
        t["activity_code_activity"], t["job_activity"], t["country"], t["region"], part
    )
    enquiry_row = kpis.figures_row(
        enquiries,
        kpis.enquiry_growth_figures(),
        kpis.enquiry_share_figures(divisions, transfers),
        kpis.sector_figures("enquiry", "active", sectors),
    )
    invoice_row = kpis.figures_row(
        invoices,
        kpis.invoice_growth_figures(),
        kpis.invoice_share_figures(divisions),
        kpis.sector_figures("invoice", "current_net", sectors),
    )
    return [
        ("country", kpis.country_board(t["client_activity"], w, part)),
        ("client", kpis.client_board(t["client_activity"], t["client"], w, part)),
        ("activity", kpis.activity_code_lifecycle_counts(codes, w)),
        ("amount", enquiry_row),
        ("amount", invoice_row),
    ]


def kpi_metrics(
    tables: Mapping[str, DataFrame], w: Windows, part: Slice = NO_SLICE, **names: Mapping[int, str]
) -> DataFrame:
    """The board in long form: rows (metric, value).

    The one-row pieces are put together by UNION, never by a cross join.
    """
    pieces = kpi_pieces(tables, w, part, **names)
    return reduce(DataFrame.unionByName, [_metrics(row, prefix) for prefix, row in pieces])


def whole_board(
    tables: Mapping[str, DataFrame], w: Windows, part: Slice = NO_SLICE, **names: Mapping[int, str]
) -> DataFrame:
    """All figures of the board as one row."""
    pieces = kpi_pieces(tables, w, part, **names)
    metrics = reduce(DataFrame.unionByName, [_metrics(row, prefix) for prefix, row in pieces])
    return kpi_board(metrics, [f"{prefix}_{column}" for prefix, row in pieces for column in row.columns])


def kpi_board(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """The board as one row with the named metrics as columns, 0 where one is absent."""
    value = F.col("value")
    return metrics.agg(
        *[
            F.coalesce(F.max(F.when(F.col("metric") == name, value)), F.lit(0.0)).alias(name)
            for name in names
        ]
    )
