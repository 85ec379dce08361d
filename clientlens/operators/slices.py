"""Slices, lifecycle segments and other predicates.

Everything here only adds filters, so Catalyst is free to push them to the Parquet scan
whenever the column comes straight from a base table.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientlens.functions import in_window, sql
from clientlens.model import (
    BLACKLISTED_STATUS,
    CLOSED_STATUS,
    ENQUIRY_STATUS,
    HIGH_VALUE,
    Slice,
    Windows,
)

# Dimension of a slice -> column that carries it in the conformed views and activity tables.
VIEW_COLUMNS = {
    "division": "division",
    "subdivision": "sub_division",
    "country": "country_id",
    "region": "region_id",
    "sector": "client_type",
}
ENQUIRY_COLUMNS = {**VIEW_COLUMNS, "subdivision": "subdivision"}
INVOICE_COLUMNS = {**VIEW_COLUMNS, "division": "dimension2_id", "subdivision": "dimension3_id"}

ENQUIRY_KINDS = (
    "active_enq", "inactive_enq", "lost_enq", "blacklisted_enq", "nonexisting_enq", "idle_enq",
)
JOB_KINDS = (
    "total_job", "job_active", "job_inactive", "job_lost", "job_blacklisted",
    "job_nonexisting", "idle_job",
)


def as_number(df: DataFrame, name: str) -> Column:
    """A key column as a number; text that is none becomes null."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.nullif(F.trim(F.col(name)), F.lit("")).try_cast("bigint")
    return F.col(name)


def slice_by(
    df: DataFrame, part: Slice, columns: Mapping[str, str] = VIEW_COLUMNS
) -> DataFrame:
    """Rows equal to the slice on each dimension it names; unparsable keys never match."""
    for dimension, name in columns.items():
        wanted = getattr(part, dimension)
        if wanted is not None:
            df = df.filter(as_number(df, name) == F.lit(wanted))
    return df


def exclude_other_slice(
    df: DataFrame,
    division: int | None = None,
    subdivision: int | None = None,
    columns: Mapping[str, str] = VIEW_COLUMNS,
) -> DataFrame:
    """The complement that idle listings report on: business with the *other* divisions.

    Each given dimension must differ, and a null dimension never differs.
    """
    for dimension, unwanted in (("division", division), ("subdivision", subdivision)):
        if unwanted is not None:
            df = df.filter(as_number(df, columns[dimension]) != F.lit(unwanted))
    return df


# Predicates below are SQL text over column names: they compose, and each becomes one
# expression in a single call to the JVM.


def inside(part: Slice, columns: Mapping[str, str] = VIEW_COLUMNS) -> str:
    """The slice as one predicate, for conditional aggregates over a shared scan."""
    tests = [
        f"{sql.name(name)} = {sql.ids([getattr(part, dimension)])}"
        for dimension, name in columns.items()
        if getattr(part, dimension) is not None
    ]
    return f"coalesce({' AND '.join(tests)}, false)" if tests else "true"


def is_active(day: str, w: Windows) -> str:
    return f"{day} BETWEEN DATE'{w.active_from}' AND DATE'{w.active_to}'"


def is_inactive(day: str, w: Windows) -> str:
    return f"{day} BETWEEN DATE'{w.inactive_from}' AND DATE'{w.inactive_to}'"


def is_lost(day: str, w: Windows) -> str:
    return f"({has_history(day, w)} AND {day} <= DATE'{w.lost_to}')"


def has_history(day: str, w: Windows) -> str:
    return f"{day} > DATE'{w.floor}'"


def segment(
    kind: str | None,
    w: Windows,
    enquiry: str = "enquiry_date",
    job: str = "job_date",
    status: str = "status_id",
) -> str:
    """Predicate of one lifecycle segment. The segments may overlap, so they are not a CASE."""
    blacklisted = f"{status} IN ({sql.ids(BLACKLISTED_STATUS)})"
    closed = f"{status} IN ({sql.ids(CLOSED_STATUS)})"
    done_by_now = f"{has_history(job, w)} AND {job} <= DATE'{w.active_to}'"
    predicates = {
        "active_enq": is_active(enquiry, w),
        "inactive_enq": is_inactive(enquiry, w),
        "lost_enq": is_lost(enquiry, w),
        "total_job": done_by_now,
        "job_active": is_active(job, w),
        "job_inactive": is_inactive(job, w),
        "job_lost": is_lost(job, w),
        "job_blacklisted": f"{blacklisted} AND {has_history(job, w)}",
        "job_nonexisting": f"{closed} AND {has_history(job, w)}",
        "blacklisted_enq": f"{blacklisted} AND {has_history(enquiry, w)}",
        "nonexisting_enq": f"{closed} AND {has_history(enquiry, w)}",
        "idle_enq": has_history(enquiry, w),
        "idle_job": done_by_now,
        None: f"{enquiry} >= DATE'{w.floor}'",
    }
    if kind not in predicates:
        raise ValueError(f"unknown lifecycle segment: {kind!r}")
    return predicates[kind]


def lifecycle_filter(df: DataFrame, kind: str | None, w: Windows, **columns: str) -> DataFrame:
    return df.filter(segment(kind, w, **columns))


def in_group(df: DataFrame, col: str, ids: Iterable[int]) -> DataFrame:
    """Rows whose key is in a named id group; the group is a short literal list."""
    return df.filter(F.col(col).isin(*ids))


def between_dates(
    df: DataFrame, col: str, start: date | None = None, end: date | None = None
) -> DataFrame:
    """Rows of a date window, both ends included.

    A snapshot laid out in year folders is pruned to the folders of the window as well.
    """
    year = year_folder(col)
    if year in df.columns:
        if start is not None:
            df = df.filter(F.col(year) >= start.year)
        if end is not None:
            df = df.filter(F.col(year) <= end.year)
    return df.filter(in_window(F.col(col), start, end))


def year_folder(col: str) -> str:
    """Name of the partition column that holds the year of a date column."""
    return f"{col}_year"


def high_value(df: DataFrame, threshold: float = HIGH_VALUE, amount: str = "amount") -> DataFrame:
    """Live top-level enquiries of known status with an amount over the threshold."""
    return df.filter(
        (F.col(amount) > F.lit(threshold))
        & (F.col("parent_id") == 0)
        & (F.col("is_active") == 1)
        & (F.col("enq_status") <= max(ENQUIRY_STATUS))
    )
