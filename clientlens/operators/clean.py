"""Cleaning of extracted tables: dates, numbers, keys, unusable output values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientlens.functions import coerce_number, key_text, midnight_date, sql, zero_if_unusable

DATE_SUFFIXES = ("date", "date_")


def normalize_dates(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    suffixes: Sequence[str] = DATE_SUFFIXES,
) -> DataFrame:
    """Date columns as DATE; anything but a plain `yyyy-MM-dd` day becomes null.

    Without `cols`, every column whose name ends in one of `suffixes` is taken.
    """
    if cols is None:
        cols = [f.name for f in df.schema if f.name.lower().endswith(tuple(suffixes))]
    parsed = {}
    for name in cols:
        kind = df.schema[name].dataType
        if isinstance(kind, T.DateType):
            continue
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            parsed[name] = midnight_date(F.col(name))
        else:
            parsed[name] = F.try_to_date(F.col(name).cast("string"), "yyyy-MM-dd")
    return df.withColumns(parsed) if parsed else df


def coerce_numeric(df: DataFrame, cols: Sequence[str], default: float = 0.0) -> DataFrame:
    return df.withColumns({name: coerce_number(F.col(name), default) for name in cols})


def normalize_key(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, key_text(F.col(col)))


def zero_fill(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Nulls of numeric columns, and NaN and infinities of floating ones, become 0."""
    fields = [f for f in df.schema if cols is None or f.name in cols]
    filled = {}
    for f in fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            filled[f.name] = zero_if_unusable(f.name)
        elif isinstance(f.dataType, T.NumericType):
            filled[f.name] = F.expr(f"coalesce({sql.name(f.name)}, CAST(0 AS {f.dataType.simpleString()}))")
    return df.withColumns(filled) if filled else df
