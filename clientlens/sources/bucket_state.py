"""States dealt into hash buckets with a digest each, so that only buckets that changed are compared, read and written.

A run that finds what it found the last time, but for a few clients, leaves nearly all buckets as they are. Digests do not depend on the order of
rows: the number of rows and the sum of their hashes. One row for each bucket goes to the driver, and their number is a parameter.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientlens.sources import commits

BUCKET = "_bucket"
_ROWS, _WRITE = "rows", "write"


def bucket_of(key: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def digests(df: DataFrame, key: Sequence[str], buckets: int, of: Sequence[str] = ()) -> dict[str, str]:
    """The digest of each bucket that has rows; `of`: the columns that count, by default all."""
    columns = sorted(of or df.columns)
    found = df.groupBy(bucket_of(key, buckets).alias(BUCKET)).agg(
        F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("sum")
    )
    return {str(r[BUCKET]): f"{r['n']} {r['sum']}" for r in found.collect()}


def _differ(old: dict[str, dict], new: dict[str, str]) -> list[int]:
    return sorted(int(b) for b in old.keys() | new.keys() if old.get(b, {}).get("digest") != new.get(b))


def _typed(df: DataFrame, entry: dict) -> DataFrame:
    """With the types of the state, as equal numbers of other types have other hashes."""
    kinds = {f.name: f.dataType for f in T.StructType.fromJson(entry["schema"])}
    return df.withColumns({c: F.col(c).cast(kinds[c]) for c in df.columns if c in kinds})


def changed_buckets(df: DataFrame, path: str) -> list[int]:
    """The buckets in which `df` differs from the committed state, by the columns that the state's digests are of."""
    _, entry = commits.latest(df.sparkSession, path)
    if entry is None:
        raise ValueError(f"there is no state in {path}")
    return _differ(entry["buckets"], digests(_typed(df, entry), entry["key"], entry["n"], entry["of"]))


def replace_buckets(df: DataFrame, path: str, key: Iterable[str], buckets: int = 64, of: Sequence[str] = (), tries: int = commits.TRIES) -> list[int]:
    """Commit `df` as the state; only buckets that differ from the committed one are written. Returns these buckets.

    Another key, number of buckets or set of columns writes all of them. If another run commits meanwhile, the comparison is made anew.
    The rows are worked out once and staged, so that digests and rows agree.
    """
    spark, key, of = df.sparkSession, list(key), sorted(of or df.columns)
    staged = f"{path}/{commits.fresh('_staged')}"
    df.write.parquet(staged)
    try:
        return _replace(spark.read.schema(df.schema).parquet(staged), path, key, buckets, of, tries)
    finally:
        commits.discard(spark, staged)


def _replace(df: DataFrame, path: str, key: list[str], buckets: int, of: list[str], tries: int) -> list[int]:
    spark, now = df.sparkSession, digests(df, key, buckets, of)
    for _ in range(tries):
        number, entry = commits.latest(spark, path)
        alike = entry is not None and (entry["key"], entry["n"], entry["of"]) == (key, buckets, of)
        old = entry["buckets"] if alike else {}
        changed = _differ(old, now)
        if not changed and entry is not None and (alike or not now):
            return []
        kept = {b: part for b, part in old.items() if int(b) not in set(changed)}
        name = commits.fresh("w")
        written = [b for b in changed if str(b) in now]
        if written:
            rows = df.withColumn(BUCKET, bucket_of(key, buckets)).filter(F.col(BUCKET).isin(written))
            rows.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/{_ROWS}/{_WRITE}={name}")
        fresh = {str(b): {_WRITE: name, "digest": now[str(b)]} for b in written}
        made = {"schema": df.schema.jsonValue(), "key": key, "n": buckets, "of": of, "buckets": {**kept, **fresh}}
        if commits.try_commit(spark, path, number + 1, made):
            return changed
        commits.discard(spark, f"{path}/{_ROWS}/{_WRITE}={name}")
    raise commits.Conflict(f"{tries} times another run was faster in {path}")


def read_buckets(spark: SparkSession, path: str, only: Iterable[int] | None = None, version: int | None = None) -> DataFrame:
    """The rows of the state, or of some of its buckets; no other files are read."""
    entry = commits.latest(spark, path)[1] if version is None else commits.record(spark, path, version)
    if entry is None:
        raise ValueError(f"there is no state in {path}")
    schema = T.StructType.fromJson(entry["schema"])
    wanted = None if only is None else set(only)
    folders = [
        f"{path}/{_ROWS}/{_WRITE}={part[_WRITE]}/{BUCKET}={b}"
        for b, part in sorted(entry["buckets"].items())
        if wanted is None or int(b) in wanted
    ]
    if not folders:
        return spark.createDataFrame([], schema)
    full = T.StructType([*schema, T.StructField(_WRITE, T.StringType()), T.StructField(BUCKET, T.IntegerType())])
    return spark.read.schema(full).option("basePath", f"{path}/{_ROWS}").parquet(*folders).select(*schema.fieldNames())


def in_buckets(df: DataFrame, path: str, only: Iterable[int]) -> DataFrame:
    """The rows of `df` that belong to some buckets of a state."""
    _, entry = commits.latest(df.sparkSession, path)
    return _typed(df, entry).filter(bucket_of(entry["key"], entry["n"]).isin(list(only)))
