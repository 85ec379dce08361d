"""Aggregates of a snapshot that are kept up to date: one part for each year, worked out again only where the year was.

C4 to C7 want the last dates of a client, country or code, and the smallest of some columns beside them. Both can be merged: a rollup holds them for each
cell and year, and has the columns of the table that it is of, so that the operators take it in place of the table. A part remembers
which write of the snapshot it was made from. After a merge or a replaced year, `refresh` reads the years whose write is another one, and no more.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientlens.sources import commits, snapshots


@dataclass(frozen=True)
class Rollup:
    """What is kept: cells by `keys`, the latest of some columns and the least of others.

    `floor_of`: rows before and since `floor` by this date are kept apart, for operators that leave the earlier ones out. `where`: rows to keep.
    """

    keys: tuple[str, ...]
    latest: tuple[str, ...]
    least: tuple[str, ...] = ()
    floor_of: str | None = None
    floor: date | None = None
    where: str | None = None

    def of(self, rows: DataFrame, year_of: str) -> DataFrame:
        """The cells of each year by itself: a year that changes takes nothing of another with it."""
        if self.where is not None:
            rows = rows.filter(self.where)
        cells = [*[F.col(k) for k in self.keys], F.year(year_of).alias("_year")]
        if self.floor_of is not None and self.floor is not None:
            cells.append((F.col(self.floor_of) >= F.lit(self.floor)).alias("_since"))
        grouped = rows.groupBy(*cells).agg(
            *[F.max(c).alias(c) for c in self.latest], *[F.min(c).alias(c) for c in self.least]
        )
        return grouped.select(*self.keys, *self.latest, *self.least)

    def described(self) -> dict:
        return {
            "keys": list(self.keys), "latest": list(self.latest), "least": list(self.least),
            "floor_of": self.floor_of, "floor": str(self.floor), "where": self.where,
        }


def activity_rollup(floor: date) -> Rollup:
    """For C4, C5 and C7: the columns of `client_activity` that they read."""
    keys = ("debtor_no", "temp_client_id", "division", "sub_division", "country_id", "region_id", "client_type")
    return Rollup(keys, ("enquiry_date", "job_date"), floor_of="enquiry_date", floor=floor)


#: For C6: the columns of `activity_code_activity` that it reads.
CODE_ROLLUP = Rollup(
    ("activity_code", "country_id", "client_type"),
    ("enquiry_date", "job_date"),
    ("debtor_no", "division", "sub_division"),
)


def _sources(parts: Mapping[str, Mapping]) -> dict[str, str]:
    return {year: part["write"] for year, part in parts.items() if part["rows"]}


def refresh(spark: SparkSession, source: str, target: str, rollup: Rollup, tries: int = commits.TRIES) -> list[str]:
    """Bring the rollup in `target` to the newest version of the snapshot in `source`; returns the years that were read.

    The snapshot must be laid out by year of one of the rollup's `latest` columns. Another rollup than the one kept starts anew. If another
    run commits meanwhile, what is stale is looked up again.
    """
    for _ in range(tries):
        _, entry = commits.latest(spark, source)
        if entry is None:
            raise ValueError(f"there is no snapshot in {source}")
        year_of, parts = entry["year_of"], entry["parts"]
        if year_of not in rollup.latest:
            raise ValueError(f"a snapshot by {year_of} has no years for a rollup of {rollup.latest}")
        number, kept = commits.latest(spark, target)
        known = kept["parts"] if kept is not None and kept["about"] == rollup.described() else {}
        wanted = _sources(parts)
        stale = sorted(y for y, write in wanted.items() if known.get(y, {}).get("of") != write)
        if not stale and known.keys() <= wanted.keys() and kept is not None and (known or not wanted):
            return []
        schema = T.StructType.fromJson(entry["schema"])
        rows = snapshots.read_parts(spark, source, {y: parts[y] for y in stale}, schema, year_of)
        made = rollup.of(rows.select(*schema.fieldNames()), year_of)
        name = snapshots.write_rows(made, target, year_of)
        # a year may be left without rows by `where`: it is known all the same
        written = snapshots.parts_of(spark, target, name, made.schema, year_of, [])
        empty = {"write": name, "rows": 0, "least": None, "most": None}
        fresh = {y: {**written.get(y, empty), "of": wanted[y]} for y in stale}
        current = {y: part for y, part in known.items() if y in wanted}
        manifest = {**snapshots.manifest(made.schema, year_of, [], {**current, **fresh}), "about": rollup.described()}
        if commits.try_commit(spark, target, number + 1, manifest):
            return stale
        commits.discard(spark, snapshots.write_folder(target, name))
    raise commits.Conflict(f"{tries} times another run was faster in {target}")


def read_rollup(spark: SparkSession, target: str) -> DataFrame:
    """The cells of all years, to be merged by the operator that reads them."""
    return snapshots.read_snapshot(spark, target)
