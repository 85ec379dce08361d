"""Running numbers per report section."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientlens.sources.workdir import shared_folder

_PLACE_BITS = 33  # monotonically_increasing_id() is the partition's number and 33 bits of place


def numbered(
    df: DataFrame, order: Sequence[Column], section: Sequence[str] = (), name: str = "no"
) -> DataFrame:
    """1, 2, 3... within each section, in the given order; the order should be total.

    A plain row_number would sort a whole section in one task, and one section may hold a third of all rows. Instead
    the rows are range-partitioned by section and order and sorted inside their partitions, so every section spans as
    many partitions as it needs and lies in one piece in each. A row's number is its place in its partition, less that
    of the section's first row there, plus the section's rows in earlier partitions. The rows move once; they are
    written to the shared folder, since counts and rows must agree on the place of every row even if an executor is lost. They are
    written as given before that, as the ranges are found from a sample: what they come from is worked out once.
    """
    spark, section = df.sparkSession, list(section)
    folder = f"{shared_folder(spark)}/numbered-{uuid.uuid4().hex}"
    keys = [F.col(s) for s in section]
    df.write.parquet(f"{folder}/given")
    (
        spark.read.schema(df.schema).parquet(f"{folder}/given").repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_place", F.monotonically_increasing_id())
        .write.parquet(f"{folder}/rows")
    )
    rows = spark.read.parquet(f"{folder}/rows").withColumn("_part", F.shiftright("_place", _PLACE_BITS))
    # one row per section and partition it touches: at most sections + partitions rows
    pieces = rows.groupBy(*section, "_part").agg(F.count("*").alias("_rows"), F.min("_place").alias("_first"))
    earlier = Window.partitionBy(*section).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces.select(
        *[F.col(s).alias(f"_{s}") for s in section],
        F.col("_part").alias("_offset_part"),
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) + 1 - F.col("_first")).alias("_offset"),
    ).write.parquet(f"{folder}/offsets")
    offsets = spark.read.parquet(f"{folder}/offsets")
    same = F.col("_part") == F.col("_offset_part")
    for s in section:
        same = same & F.col(s).eqNullSafe(F.col(f"_{s}"))
    return (
        rows.join(offsets, same)
        .withColumn(name, F.col("_place") + F.col("_offset"))
        .drop("_part", "_place", "_offset_part", "_offset", *[f"_{s}" for s in section])
    )
