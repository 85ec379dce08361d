"""Snapshots dealt into buckets by key, so that tables with the same buckets are joined and grouped by that key without a shuffle.

Spark knows the buckets of a table from its catalog only. A bucketed snapshot therefore keeps its bucketing in its manifest, and whoever
reads it declares its files as a table of the session's catalog.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientlens.operators.slices import year_folder
from clientlens.sources import commits, snapshots

_PREFIX = "clientlens_bucketed_"


def _table(write: str) -> str:
    return _PREFIX + write.replace("-", "_")


def write_bucketed(df: DataFrame, path: str, key: Iterable[str], buckets: int, year_of: str | None = None) -> int:
    """The next version of a snapshot in `buckets` buckets by `key`, sorted by it; with `year_of`, in folders by year besides.

    Rows are dealt once, to as many tasks as there are buckets, so that each bucket is one file a year. For a join without a shuffle, both tables
    need the same number of buckets and keys of the same types in the same order. One key with many rows makes one large bucket: take keys
    that have few rows each, as the number of an invoice.
    """
    spark, key = df.sparkSession, list(key)
    name = commits.fresh("w")
    rows = df.repartition(buckets, *key)
    writer = rows.withColumn(year_folder(year_of), F.year(year_of)).write if year_of else rows.write
    if year_of:
        writer = writer.partitionBy(year_folder(year_of))
    writer.bucketBy(buckets, *key).sortBy(*key).option("path", snapshots.write_folder(path, name)).saveAsTable(_table(name))
    entry = {"schema": df.schema.jsonValue(), "year_of": year_of, "key": key, "buckets": buckets, "write": name}
    return commits.commit(spark, path, lambda number, latest: entry)


def read_bucketed(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest version, or the one asked for, as a table whose buckets Spark knows."""
    entry = commits.latest(spark, path)[1] if version is None else commits.record(spark, path, version)
    if entry is None:
        raise ValueError(f"there is no snapshot in {path}")
    name = _table(entry["write"])
    if not spark.catalog.tableExists(name):
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromJson(entry["schema"])]
        key = ", ".join(f"`{k}`" for k in entry["key"])
        year = f"`{year_folder(entry['year_of'])}`" if entry["year_of"] else None
        spark.sql(
            f"CREATE TABLE {name} ({', '.join([*fields, *([f'{year} int'] if year else [])])}) USING parquet "
            + (f"PARTITIONED BY ({year}) " if year else "")
            + f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {entry['buckets']} BUCKETS "
            f"LOCATION '{snapshots.write_folder(path, entry['write'])}'"
        )
        if year:
            spark.catalog.recoverPartitions(name)
    return spark.table(name)
