"""State tables that one run leaves for the next.

A state is a folder of versions. A run reads the latest one, writes its rows to a folder of their own, and then commits that
folder as the next version. A path being read is never overwritten, of two runs at once each gets a version of its own, and a run that fails
before its commit leaves everything as it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clientlens.sources import commits
from clientlens.sources.commits import Conflict

_DATA = "data"


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the committed versions, oldest first."""
    return commits.numbers(spark, path)


def _rows(spark: SparkSession, path: str, entry: dict | None, schema: StructType | str, seed: DataFrame | None) -> DataFrame:
    if entry is not None:
        return spark.read.schema(schema).parquet(f"{path}/{entry[_DATA]}")
    return seed if seed is not None else spark.createDataFrame([], schema)


def read_state(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    seed: DataFrame | None = None,
    version: int | None = None,
) -> DataFrame:
    """The latest version, or the one asked for; where there is none, the seed, or no rows."""
    entry = commits.latest(spark, path)[1] if version is None else commits.record(spark, path, version)
    return _rows(spark, path, entry, schema, seed)


def replace_state(df: DataFrame, path: str, based_on: int | None = None) -> int:
    """Commit the next version, after the report of this run is out; returns its number.

    `based_on`: the version that `df` was worked out from (0 for none). If another one has been committed since, this is a
    Conflict and nothing changes; `update_state` works it out again then.
    """
    spark, name = df.sparkSession, commits.fresh(_DATA)
    df.write.parquet(f"{path}/{name}")
    if based_on is None:
        return commits.commit(spark, path, lambda number, entry: {_DATA: name})
    if commits.latest(spark, path)[0] == based_on and commits.try_commit(spark, path, based_on + 1, {_DATA: name}):
        return based_on + 1
    commits.discard(spark, f"{path}/{name}")
    raise Conflict(f"{path} went on from version {based_on}")


def update_state(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    change: Callable[[DataFrame], DataFrame],
    seed: DataFrame | None = None,
    tries: int = commits.TRIES,
) -> int:
    """The next version is `change` of the latest one, whatever other runs commit in between; returns its number.

    Where another run was faster, `change` is asked again with that run's version, so no run's change is lost.
    """
    for _ in range(tries):
        number, entry = commits.latest(spark, path)
        try:
            return replace_state(change(_rows(spark, path, entry, schema, seed)), path, number)
        except Conflict:
            continue
    raise Conflict(f"{tries} times another run was faster in {path}")


def clean_up(spark: SparkSession, path: str, keep: int = 2, idle_hours: float = 24) -> list[str]:
    """Remove what no version but the last `keep` needs; returns the removed folders' names.

    Folders in which something was written within `idle_hours` stay, since their run may be about to commit them.
    """
    known = commits.numbers(spark, path)
    needed = {commits.record(spark, path, n)[_DATA] for n in known[-keep:]}
    old = [
        name
        for name, hours in commits.children(spark, path).items()
        if name.startswith(f"{_DATA}-") and name not in needed and hours >= idle_hours
    ]
    commits.forget(spark, path, known[: max(0, len(known) - keep)])
    for name in old:
        commits.discard(spark, f"{path}/{name}")
    return sorted(old)


def update_tracking(
    tracked: DataFrame,
    recovered: DataFrame,
    current: DataFrame,
    logged_at: Column | None = None,
) -> DataFrame:
    """Drop recovered keys, then add the current ones that are not tracked yet.

    The keys are client and division. `logged_at`, the time of the run, goes into that column of added rows only. The
    three inputs meet in one aggregate. Running it again with the same input changes nothing but for keys that recovered and are
    inactive again: these are added anew.
    """
    keys = ["debtor_no", "division_id"]
    kept = [c for c in tracked.columns if c not in keys]

    def tagged(df: DataFrame, tag: str) -> DataFrame:
        nothing = {c: F.lit(None).cast(tracked.schema[c].dataType) for c in kept if c not in df.columns}
        if tag == "current" and logged_at is not None and "logged_at" in kept:
            nothing["logged_at"] = logged_at.cast(tracked.schema["logged_at"].dataType)
        return df.withColumns(nothing).select(*keys, *kept, F.lit(tag).alias("_from"))

    rows = tagged(tracked, "tracked").unionByName(tagged(current, "current"))
    rows = rows.unionByName(tagged(recovered.select(*keys), "recovered"))

    def latest(tag: str) -> list[Column]:
        return [F.max(F.when(F.col("_from") == tag, F.col(c))).alias(f"_{tag}_{c}") for c in kept]

    def any_of(tag: str) -> Column:
        return F.bool_or(F.col("_from") == tag).alias(f"_{tag}")

    by_key = rows.groupBy(*keys).agg(
        *latest("tracked"), *latest("current"), *[any_of(tag) for tag in ("tracked", "recovered", "current")]
    )
    stays = F.col("_tracked") & ~F.col("_recovered")
    return by_key.filter(stays | F.col("_current")).select(
        *keys, *[F.when(stays, F.col(f"_tracked_{c}")).otherwise(F.col(f"_current_{c}")).alias(c) for c in kept]
    ).select(*tracked.columns)
