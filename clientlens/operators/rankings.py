"""Top-N rankings and amounts by region and country.

All of them start from one row per client, so the client with the most rows costs no more
than any other in the joins that follow; the top n is Spark's TakeOrderedAndProject.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientlens.functions import report_money
from clientlens.model import EXCLUDED_SECTOR, GCC_COUNTRIES, NO_SLICE, Slice, Windows
from clientlens.operators import conform
from clientlens.operators.cardinality import one_row_each
from clientlens.operators.listings import enquiry_facts
from clientlens.operators.slices import (
    ENQUIRY_COLUMNS,
    INVOICE_COLUMNS,
    between_dates,
    slice_by,
)

MILLION = 1_000_000


def scaled(total: Column, scale: int) -> Column:
    """A sum in units of `scale`, rounded to cents after summing, as DOUBLE."""
    if scale == 1:
        return report_money(total)
    digits = len(str(scale)) - 1
    if scale != 10**digits:
        raise ValueError("scale must be a power of ten")
    unit = F.lit("0." + "0" * (digits - 1) + "1").cast(f"decimal({digits + 1},{digits})")
    exact = total.cast("decimal(28,4)") * unit
    return exact.cast("decimal(28,2)").cast("double")


def _placed(df: DataFrame, t: Mapping[str, DataFrame], part: Slice) -> DataFrame:
    directory = conform.client_directory(t["client"], t["temp_client"]).drop("status_id")
    known = slice_by(df.join(directory, "client_ref", "left"), part.only("country", "sector"))
    known = one_row_each(known, "client_ref", of=conform.DIRECTORY)
    return slice_by(
        conform.attach_country(known, t["country"], t["region"]), part.only("region")
    )


def enquiry_amounts(tables: Mapping[str, DataFrame], w: Windows, part: Slice) -> DataFrame:
    """One row per client: exact enquiry amount of the active window, and where it is."""
    facts = slice_by(tables["enquiry"], part.only("division", "subdivision"), ENQUIRY_COLUMNS)
    facts = between_dates(facts, "enquiry_date", w.active_from, w.active_to)
    sums = enquiry_facts(facts).groupBy("client_ref").agg(F.sum("amount").alias("amount"))
    return _placed(sums, tables, part)


def invoice_amounts(tables: Mapping[str, DataFrame], w: Windows, part: Slice) -> DataFrame:
    """One row per registered client: net amount and expense of its positive invoices."""
    facts = slice_by(tables["invoice"], part.only("division", "subdivision"), INVOICE_COLUMNS)
    facts = between_dates(facts, "tran_date", w.job_from, w.job_to)
    sums = (
        conform.gross_net_amounts(facts.filter(F.col("ov_amount") > 0))
        .groupBy(F.col("debtor_no").cast("bigint").alias("client_ref"))
        .agg(
            F.sum("net_amount").alias("amount"),
            F.sum("total_expense_aed").alias("expense"),
        )
    )
    return _placed(sums, tables, part).filter(F.col("client_type") != EXCLUDED_SECTOR)


def _top_clients(amounts: DataFrame, n: int, scale: int, name: str) -> DataFrame:
    ref = F.col("client_ref")
    return (
        amounts.filter(ref.isNotNull())
        .orderBy(F.col("amount").desc_nulls_last(), ref.asc())
        .limit(n)
        .select(
            conform.client_key(ref).alias("client_id"),
            "client_name",
            "country_name",
            "region_name",
            scaled(F.coalesce("amount", F.lit(0).cast("decimal(28,4)")), scale).alias(name),
        )
    )


def top_clients_by_enquiry(
    tables: Mapping[str, DataFrame],
    w: Windows,
    n: int = 10,
    part: Slice = NO_SLICE,
    scale: int = MILLION,
) -> DataFrame:
    """T1."""
    return _top_clients(enquiry_amounts(tables, w, part), n, scale, "enquiry_amount")


def top_clients_by_invoice(
    tables: Mapping[str, DataFrame],
    w: Windows,
    n: int = 10,
    part: Slice = NO_SLICE,
    scale: int = MILLION,
) -> DataFrame:
    """T4."""
    return _top_clients(invoice_amounts(tables, w, part), n, scale, "invoice_amount")


def _by_dimension(
    amounts: DataFrame, dimension: DataFrame, key: str, everything: bool, scale: int, name: str
) -> DataFrame:
    """Amount per row of a small dimension; with `everything`, also those that have none."""
    sums = amounts.groupBy(key).agg(F.sum("amount").alias("total"))
    joined = dimension.join(sums, key, "left" if everything else "inner")
    total = F.coalesce("total", F.lit(0).cast("decimal(28,4)"))
    return joined.select(*dimension.columns, scaled(total, scale).alias(name)).orderBy(
        F.col(name).desc(), key
    )


def _regions(t: Mapping[str, DataFrame]) -> DataFrame:
    colours = t["country"].groupBy("region_id").agg(F.min("colour_code").alias("colour_code"))
    return (
        t["region"]
        .select(F.col("id").alias("region_id"), F.col("name").alias("region_name"))
        .join(colours, "region_id", "left")
    )


def _countries(t: Mapping[str, DataFrame], group: Iterable[int] | None) -> DataFrame:
    named = t["country"].select(
        F.col("id").alias("country_id"), F.col("name").alias("country_name"), "colour_code"
    )
    return named if group is None else named.filter(F.col("country_id").isin(*group))


def enquiry_by_region(
    tables: Mapping[str, DataFrame],
    w: Windows,
    part: Slice = NO_SLICE,
    all_regions: bool = True,
    scale: int = MILLION,
) -> DataFrame:
    """T2."""
    return _by_dimension(
        enquiry_amounts(tables, w, part), _regions(tables), "region_id", all_regions, scale,
        "enquiry_amount",
    )


def enquiry_by_country(
    tables: Mapping[str, DataFrame],
    w: Windows,
    group: Iterable[int] | None = GCC_COUNTRIES,
    part: Slice = NO_SLICE,
    all_countries: bool = True,
    scale: int = MILLION,
) -> DataFrame:
    """T3."""
    return _by_dimension(
        enquiry_amounts(tables, w, part), _countries(tables, group), "country_id", all_countries,
        scale, "enquiry_amount",
    )


def invoice_by_region(
    tables: Mapping[str, DataFrame],
    w: Windows,
    part: Slice = NO_SLICE,
    all_regions: bool = True,
    scale: int = MILLION,
) -> DataFrame:
    """T5."""
    return _by_dimension(
        invoice_amounts(tables, w, part), _regions(tables), "region_id", all_regions, scale,
        "invoice_amount",
    )


def invoice_by_country(
    tables: Mapping[str, DataFrame],
    w: Windows,
    group: Iterable[int] | None = GCC_COUNTRIES,
    part: Slice = NO_SLICE,
    all_countries: bool = True,
    scale: int = MILLION,
) -> DataFrame:
    """T6."""
    return _by_dimension(
        invoice_amounts(tables, w, part), _countries(tables, group), "country_id", all_countries,
        scale, "invoice_amount",
    )


def client_invoice_totals(
    tables: Mapping[str, DataFrame], w: Windows, part: Slice = NO_SLICE
) -> DataFrame:
    """Net amount and expense of every client with a positive invoice, largest first."""
    return (
        invoice_amounts(tables, w, part)
        .orderBy(F.col("amount").desc_nulls_last(), "client_ref")
        .select(
            F.col("client_ref").alias("debtor_no"),
            "client_name",
            "country_name",
            "region_name",
            report_money(F.col("amount")).alias("invoice_amount"),
            report_money(F.coalesce("expense", F.lit(0).cast("decimal(28,4)"))).alias(
                "total_expense"
            ),
        )
    )
