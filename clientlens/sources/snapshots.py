"""Source tables in, Parquet snapshots out, changes merged into snapshots, snapshots back in."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientlens import schemas
from clientlens.functions import midnight_date
from clientlens.operators.slices import year_folder
from clientlens.sources import commits


def read_relational(
    spark: SparkSession,
    url: str,
    table: str,
    key: str,
    lower: int,
    upper: int,
    partitions: int,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """A source table over JDBC, read in parallel by ranges of a numeric key of equal width."""
    return spark.read.jdbc(
        url,
        table,
        column=key,
        lowerBound=lower,
        upperBound=upper,
        numPartitions=partitions,
        properties=dict(properties or {}),
    )


def equal_depth(known: DataFrame, key: str, partitions: int, error: float = 0.001) -> list[float]:
    """Bounds that cut the keys of a table into ranges of about as many rows each.

    `known`: the last snapshot of the table, which has nearly the keys that its source has. `error`: by what share of all rows
    a bound may be off. Keys that hold more than a range's rows make fewer, larger ranges.
    """
    cuts = [i / partitions for i in range(1, partitions)]
    return sorted(set(known.select(F.col(key).cast("double").alias(key)).approxQuantile(key, cuts, error))) if cuts else []


def key_ranges(key: str, bounds: Iterable[float]) -> list[str]:
    """Conditions that every row meets one of: below the first bound or without key, between two, from the last on."""
    shown = [str(int(b)) if float(b).is_integer() else repr(float(b)) for b in sorted(set(bounds))]
    if not shown:
        return ["1 = 1"]
    between = [f"{key} >= {low} AND {key} < {high}" for low, high in zip(shown, shown[1:])]
    return [f"{key} < {shown[0]} OR {key} IS NULL", *between, f"{key} >= {shown[-1]}"]


def read_relational_ranges(
    spark: SparkSession,
    url: str,
    table: str,
    key: str,
    bounds: Iterable[float],
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """A source table over JDBC, a task for each range of its key.

    Ranges of equal width put a dense stretch of keys into one task; with the bounds of `equal_depth` each gets as many rows.
    """
    return spark.read.jdbc(url, table, predicates=key_ranges(key, bounds), properties=dict(properties or {}))


def _typed(df: DataFrame, field: T.StructField, keep_day: bool) -> Column:
    col, kind = F.col(field.name), df.schema[field.name].dataType
    if kind == field.dataType:
        return col
    if isinstance(field.dataType, T.DateType):
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return (col.cast("date") if keep_day else midnight_date(col)).alias(field.name)
        return _text_date(col, keep_day).alias(field.name)
    if isinstance(kind, T.StringType):
        col = F.nullif(F.trim(col), F.lit(""))
    return col.try_cast(field.dataType).alias(field.name)


def _text_date(col: Column, keep_day: bool = False) -> Column:
    text = col.cast("string")
    return F.try_to_date(F.substring(text, 1, 10) if keep_day else text, "yyyy-MM-dd")


def extract(
    df: DataFrame,
    schema: T.StructType,
    where: str | None = None,
    floor_column: str | None = None,
    floor: date | None = None,
    source_names: Mapping[str, str] | None = None,
    keep_day: Iterable[str] = (),
) -> DataFrame:
    """The declared columns of a source table, typed, of the rows to keep.

    Junk dates and numbers become null. The row filter and the date floor are applied to the source columns, so that
    they reach the scan; a floor column that is text is read as a date first, and junk is below every floor.
    `source_names`: what the source calls a declared column, where it has no column of that name. `keep_day`: columns of
    which the day counts whatever the time; other timestamps with a time of day are junk.
    """
    if where is not None:
        df = df.filter(where)
    for name, source in (source_names or {}).items():
        if name not in df.columns and source in df.columns:
            df = df.withColumnRenamed(source, name)
    if floor_column is not None and floor is not None:
        day = F.col(floor_column)
        if isinstance(df.schema[floor_column].dataType, T.StringType):
            day = _text_date(day, floor_column in keep_day)
        df = df.filter(day >= F.lit(floor))
    return df.select(*[_typed(df, field, field.name in keep_day) for field in schema])


def extract_table(df: DataFrame, table: str, floor: date | None = None) -> DataFrame:
    """`extract` with all that is declared for a known table."""
    return extract(
        df,
        schemas.schema(table),
        schemas.ROW_FILTER.get(table),
        schemas.FLOOR_COLUMN.get(table),
        floor,
        schemas.SOURCE_NAME.get(table),
        schemas.KEEP_DAY.get(table, ()),
    )


# A snapshot is a folder of committed manifests (see `commits`). A manifest holds the schema and, of each year, which write holds its rows, how
# many they are, and the range of their key. Writes are folders that never change: rows/write=<name>/<year folder>.
# Readers never see a table half written, and a failed write changes nothing.
_ROWS, _WRITE, _NO_YEAR = "rows", "write", "__HIVE_DEFAULT_PARTITION__"


def _year_name(year: int | None) -> str:
    return _NO_YEAR if year is None else str(year)


def write_folder(path: str, name: str) -> str:
    return f"{path}/{_ROWS}/{_WRITE}={name}"


def write_rows(df: DataFrame, path: str, year_of: str | None, rows_per_file: int = 0) -> str:
    """Write rows to a folder of their own, by year if there is a date to go by; returns its name."""
    name = commits.fresh("w")
    target = write_folder(path, name)
    limits = {"maxRecordsPerFile": rows_per_file} if rows_per_file else {}
    if year_of is None:
        df.write.options(**limits).parquet(target)
        return name
    year = year_folder(year_of)
    (
        df.withColumn(year, F.year(year_of))
        .hint("rebalance", F.col(year))
        .sortWithinPartitions(year, year_of)
        .write.options(**limits)
        .partitionBy(year)
        .parquet(target)
    )
    return name


def _with_year(schema: T.StructType, year_of: str | None) -> T.StructType:
    year = [T.StructField(year_folder(year_of), T.IntegerType())] if year_of else []
    return T.StructType([*(f for f in schema if not year or f.name != year[0].name), *year])


def read_parts(
    spark: SparkSession, path: str, parts: Mapping[str, Mapping], schema: T.StructType, year_of: str | None
) -> DataFrame:
    """The rows of some parts of a manifest, as one scan whose year folders Spark can prune."""
    full = _with_year(schema, year_of)
    parts = {name: part for name, part in parts.items() if part["rows"] or not year_of}
    if not parts:
        return spark.createDataFrame([], full)
    within = (lambda name: f"/{year_folder(year_of)}={name}") if year_of else (lambda name: "")
    folders = [f"{write_folder(path, part[_WRITE])}{within(name)}" for name, part in parts.items()]
    typed = T.StructType([*full, T.StructField(_WRITE, T.StringType())])
    return spark.read.schema(typed).option("basePath", f"{path}/{_ROWS}").parquet(*folders).select(*full.fieldNames())


def parts_of(spark: SparkSession, path: str, name: str, schema: T.StructType, year_of: str | None, key: list[str]) -> dict[str, dict]:
    """The parts of one write: number of rows and, of a whole-numbered first key column, the range, for each year."""
    target = write_folder(path, name)
    full = _with_year(schema, year_of)
    rows = spark.read.schema(full).parquet(target)
    ranged = bool(key) and isinstance(schema[key[0]].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    least, most = (F.min(key[0]), F.max(key[0])) if ranged else (F.lit(None), F.lit(None))
    by = [F.col(year_folder(year_of)).alias("_year")] if year_of else []
    found = rows.groupBy(*by).agg(F.count("*").alias("_rows"), least.alias("_least"), most.alias("_most")).collect()
    return {
        _year_name(r["_year"]) if year_of else "": {_WRITE: name, "rows": r["_rows"], "least": r["_least"], "most": r["_most"]}
        for r in found
    }


def manifest(schema: T.StructType, year_of: str | None, key: list[str], parts: Mapping[str, Mapping]) -> dict:
    return {"schema": schema.jsonValue(), "year_of": year_of, "key": key, "parts": dict(parts)}


def write_snapshot(
    df: DataFrame,
    path: str,
    year_of: str | None = None,
    years: Iterable[int] | None = None,
    key: Iterable[str] = (),
    rows_per_file: int = 0,
) -> int:
    """The next version of a snapshot, which is returned; with `year_of`, one folder per year of that date column.

    With `years`, only rows of these years are written, and they replace those of the earlier version, also where there are none any more; all
    other years stay as they are. With a `key` besides, rows of other years whose key is written go too: they moved. Without one, a
    row that moved into the years stands in its old year as well, unless that is named too.

    The rebalance hint lets AQE split a year that holds most of the rows over many tasks and files, and merge small
    ones. Rows are sorted by date inside each file, so that the Parquet statistics prune row groups within a year. `rows_per_file`: of this
    write, at most; by default the session's own limit, if it has one.
    """
    spark, key = df.sparkSession, list(key)
    if year_of is None or years is None:
        name = write_rows(df, path, year_of, rows_per_file)
        parts = parts_of(spark, path, name, df.schema, year_of, key)
        return commits.commit(spark, path, lambda number, entry: manifest(df.schema, year_of, key, parts))
    years = sorted(set(years))
    rows = df.filter(F.year(year_of).isin(*years))
    if key and commits.numbers(spark, path):
        return merge_snapshot(rows, path, key, years=years)
    name = write_rows(rows, path, year_of, rows_per_file)
    parts = parts_of(spark, path, name, df.schema, year_of, key)

    def with_others(number: int, entry: dict | None) -> dict:
        kept = {y: part for y, part in (entry or {"parts": {}})["parts"].items() if y not in map(str, years)}
        return manifest(df.schema, year_of, key, {**kept, **parts})

    return commits.commit(spark, path, with_others)


def merge_snapshot(
    changes: DataFrame,
    path: str,
    key: Iterable[str] | None = None,
    deleted: str | None = None,
    years: Iterable[int] = (),
    tries: int = commits.TRIES,
) -> int:
    """Put changed and new rows into a snapshot and take deleted ones out, by key; returns the version.

    `changes` has the snapshot's columns and, with `deleted`, a boolean of that name: such rows only name a key that goes. A row replaces all rows
    with its key, in whatever year they stand, so one whose date moved to another year counts once. Only years that lose or get rows
    are written again. All rows of `years` go, but for those in `changes`. `key`: by default the one the snapshot was written with.

    Where a changed key stands now is looked up in years whose key range holds a changed key, reading the key alone. Null keys
    and keys that `changes` holds twice are an error. If another writer commits meanwhile, the merge is worked out again on that version.
    """
    spark = changes.sparkSession
    if not commits.numbers(spark, path):
        raise ValueError(f"there is no snapshot in {path}")
    staged = f"{path}/{commits.fresh('_staged')}"
    changes.write.parquet(staged)
    changes = spark.read.schema(changes.schema).parquet(staged)
    try:
        for _ in range(tries):
            number, entry = commits.latest(spark, path)
            by = list(key or entry["key"])
            if not by:
                raise ValueError("a merge needs a key")
            _check_keys(changes, by)
            made = _merged(changes, path, entry, by, deleted, {str(y) for y in years})
            if made is None:
                return number
            if commits.try_commit(spark, path, number + 1, made):
                return number + 1
            for write in {part[_WRITE] for part in made["parts"].values()} - {part[_WRITE] for part in entry["parts"].values()}:
                commits.discard(spark, write_folder(path, write))
        raise commits.Conflict(f"{tries} times another writer was faster in {path}")
    finally:
        commits.discard(spark, staged)


def _check_keys(changes: DataFrame, key: list[str]) -> None:
    missing = reduce(Column.__or__, [F.col(k).isNull() for k in key])
    twice = changes.groupBy(*key).agg(F.count("*").alias("_n")).filter((F.col("_n") > 1) | missing).limit(1).collect()
    if twice:
        raise ValueError(f"the changes hold {[twice[0][k] for k in key]} as {key} {twice[0]['_n']} times; a key must be there once and not be null")


def _merged(
    changes: DataFrame, path: str, entry: Mapping, key: list[str], deleted: str | None, emptied: set[str]
) -> dict | None:
    """The manifest after a merge, its new rows written; None if nothing changes."""
    spark, year_of = changes.sparkSession, entry["year_of"]
    schema, parts = T.StructType.fromJson(entry["schema"]), entry["parts"]
    keys = changes.select(*key)
    live = changes if deleted is None else changes.filter(~F.coalesce(F.col(deleted), F.lit(False)))
    live = live.select(*schema.fieldNames())

    ranges = {name: F.max(F.col(key[0]).between(p["least"], p["most"])) for name, p in parts.items() if p["least"] is not None}
    inside = keys.agg(F.count("*").alias("_n"), *[c.alias(f"_in_{name}") for name, c in ranges.items()]).first()
    if not inside["_n"] and not emptied & parts.keys():
        return None
    maybe = {n: p for n, p in parts.items() if n not in emptied and (inside[f"_in_{n}"] if n in ranges else inside["_n"] and p["rows"])}
    if year_of is None:
        touched = {""}
    else:
        year = F.col(year_folder(year_of))
        held = read_parts(spark, path, maybe, schema, year_of).select(*key, year.alias("_year")).join(keys, key, "left_semi")
        moved_in = live.select(F.year(year_of).alias("_year"))
        # One row for each year.
        touched = emptied | {_year_name(r["_year"]) for r in held.select("_year").unionAll(moved_in).distinct().collect()}
    stay = {n: p for n, p in parts.items() if n in touched and n not in emptied and p["rows"]}
    survivors = read_parts(spark, path, stay, schema, year_of).select(*schema.fieldNames()).join(keys, key, "left_anti")
    name = write_rows(survivors.select(*schema.fieldNames()).unionByName(live), path, year_of)
    written = parts_of(spark, path, name, schema, year_of, key)
    return manifest(schema, year_of, entry["key"] or key, {**{n: p for n, p in parts.items() if n not in touched}, **written})


def read_snapshot(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    year_of: str | None = None,
    version: int | None = None,
) -> DataFrame:
    """The newest version, or the one asked for; a folder of plain Parquet files is read as it is.

    The columns are those of `schema`, by default of the snapshot itself, and the year where it is laid out by year.
    """
    entry = commits.latest(spark, path)[1] if version is None else commits.record(spark, path, version)
    if entry is None:
        return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
    return read_parts(spark, path, entry["parts"], schema or T.StructType.fromJson(entry["schema"]), entry["year_of"])


def clean_up(spark: SparkSession, path: str, keep: int = 2, idle_hours: float = 24) -> list[str]:
    """Remove the writes that no version but the last `keep` needs; returns their names.

    Writes into which something was written within `idle_hours` stay, since they may be about to be committed.
    """
    known = commits.numbers(spark, path)
    needed = {part[_WRITE] for n in known[-keep:] for part in commits.record(spark, path, n)["parts"].values()}
    idle = {name.removeprefix(f"{_WRITE}="): hours for name, hours in commits.children(spark, f"{path}/{_ROWS}").items()}
    old = sorted(name for name, hours in idle.items() if name not in needed and hours >= idle_hours)
    commits.forget(spark, path, known[: max(0, len(known) - keep)])
    for name in old:
        commits.discard(spark, write_folder(path, name))
    return old


def write_snapshots(
    tables: Mapping[str, DataFrame],
    directory: str,
    concurrent: int = 4,
    years: Iterable[int] | None = None,
) -> None:
    """Write every table; a few jobs run side by side, as small ones leave a cluster idle.

    `years`: of tables in year folders, only these are written.
    """

    def write(name: str) -> None:
        year_of = schemas.YEAR_OF.get(name)
        key = [k for k in schemas.KEY.get(name, ()) if k in tables[name].columns]
        key = key if len(key) == len(schemas.KEY.get(name, ())) else []
        write_snapshot(tables[name], f"{directory}/{name}", year_of, years if year_of else None, key)

    with ThreadPoolExecutor(concurrent) as pool:
        list(pool.map(write, tables))


def merge_snapshots(changes: Mapping[str, DataFrame], directory: str, deleted: str | None = None, concurrent: int = 4) -> None:
    """`merge_snapshot` of every table by its declared key; `deleted`: as there, in tables that have such a column."""

    def merge(name: str) -> None:
        df = changes[name]
        merge_snapshot(df, f"{directory}/{name}", schemas.KEY[name], deleted if deleted in df.columns else None)

    with ThreadPoolExecutor(concurrent) as pool:
        list(pool.map(merge, changes))


def load_tables(
    spark: SparkSession,
    directory: str,
    names: Iterable[str] = schemas.SOURCE_TABLES,
    views: bool = True,
    suffix: str = "",
    declared: bool = True,
    prefix: str = "",
) -> dict[str, DataFrame]:
    """Every snapshot as a lazy DataFrame, and as a temporary view of the same name after `prefix`.

    With `declared`, the schema comes from the declaration and no file is opened to infer it. With a `suffix`, tables are
    plain Parquet files.
    """
    tables = {}
    for name in names:
        schema = schemas.schema(name) if declared else None
        if suffix:
            reader = spark.read.schema(schema) if declared else spark.read
            tables[name] = reader.parquet(f"{directory}/{name}{suffix}")
        else:
            tables[name] = read_snapshot(spark, f"{directory}/{name}", schema, schemas.YEAR_OF.get(name))
        if views:
            tables[name].createOrReplaceTempView(f"{prefix}{name}")
    return tables
