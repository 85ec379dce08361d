"""A check inside the plan that a join has not multiplied rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_row_each(df: DataFrame, *key: str, of: str) -> DataFrame:
    """The rows as they are, or an error that names a key which comes more than once; `of`: what was joined to them.

    For the result of joining something by the key that the rows were grouped by: they are dealt by it already, so counting a key's rows takes a
    sort within partitions and no shuffle. A null key counts like any other.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    shown = F.concat_ws(", ", *[F.concat(F.lit(f"{k} "), F.coalesce(F.col(k).cast("string"), F.lit("null"))) for k in key])
    message = F.concat(F.lit(f"{of} must have one row for each key, but has several for "), shown)
    once: Column = F.when(F.col("_rows_of_key") > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return df.withColumn("_rows_of_key", n).filter(once).drop("_rows_of_key")
