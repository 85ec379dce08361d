"""Column helpers; all of them compile to built-in Spark expressions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from clientlens.functions.sql import name


def exact_money(col: Column) -> Column:
    return col.cast("decimal(18,4)")


def exact_rate(col: Column) -> Column:
    return col.cast("decimal(12,6)")


def report_money(col: Column) -> Column:
    """An exact sum as the DOUBLE that reports show, fixed to four decimals first."""
    return col.cast("decimal(38,4)").cast("double")


def in_window(col: Column, start: date | None, end: date | None) -> Column:
    """Both ends included; an end that is None is open."""
    keep = F.lit(True)
    if start is not None:
        keep = keep & (col >= F.lit(start))
    if end is not None:
        keep = keep & (col <= F.lit(end))
    return keep


def safe_divide(numerator: Column, denominator: Column) -> Column:
    """0 when either side is null or NaN, or the denominator is 0."""
    ratio = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return F.coalesce(F.nanvl(ratio, F.lit(0.0)), F.lit(0.0))


def safe_percent(numerator: Column, denominator: Column, precision: int = 2) -> Column:
    """numerator as a percentage of denominator, rounded; 0 where `safe_divide` gives 0."""
    return F.round(safe_divide(numerator, denominator) * F.lit(100.0), precision)


def coerce_number(col: Column, default: float = 0.0) -> Column:
    """Text to DOUBLE; blanks, junk and null become the default instead of an ANSI error."""
    number = F.trim(col.cast("string")).try_cast("double")
    return F.coalesce(F.nanvl(number, F.lit(None).cast("double")), F.lit(float(default)))


def key_text(col: Column) -> Column:
    """A join key as trimmed text; the text `nan` counts as missing."""
    text = F.trim(col.cast("string"))
    return F.nullif(text, F.lit("nan"))


def midnight_date(col: Column) -> Column:
    """The date of a timestamp that carries no time of day, else null."""
    return F.when(col == F.date_trunc("day", col), col.cast("date"))


def zero_if_unusable(column: str) -> Column:
    """Null, NaN and infinities of a floating column become 0."""
    c = name(column)
    usable = f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) != DOUBLE('Infinity')"
    return F.expr(f"CASE WHEN {usable} THEN {c} ELSE 0D END")


def compact_amount(col: Column) -> Column:
    """1234567 -> 1.23M, 1234 -> 1.2K, 999.5 -> 999.50, and null or 0 -> 0; halves round up.

    Amounts have up to 27 digits before the point: with the six digits of a millionth, products are still exact.
    """
    value = col.cast("decimal(31,4)")
    size = F.abs(value)
    millions = (value * F.expr("0.000001BD")).cast("decimal(30,2)").cast("string")
    thousands = (value * F.expr("0.001BD")).cast("decimal(30,1)").cast("string")
    return (
        F.when(value.isNull() | (value == 0), "0")
        .when(size >= 1_000_000, F.concat(millions, F.lit("M")))
        .when(size >= 1_000, F.concat(thousands, F.lit("K")))
        .otherwise(F.format_number(value.cast("decimal(20,2)"), 2))
    )
