"""Distinct clients as bitmaps that can be merged: K2, K4, the client half of K11 and L8 of any slice from one stored table.

A client counts by its last dates inside a slice, and a last date is on or after a day if any date is. So for each day that a window begins
or ends at there is a set of clients, the set of a slice is the union of those of its cells, and every count is a sum and difference of sizes
of such sets. Sets are bitmaps over client numbers: 32,768 clients to a bitmap of 4 KB, merged by `bitmap_or_agg`. The table holds a
row for each cell, set and 32,768 clients that has some, however many rows the activity has; a day's new activity can be merged into it.

Cells are combinations of the keys that slices may name. A bitmap is worth its 4 KB where a cell has many clients: leave keys out that
no slice needs.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientlens.functions import sql
from clientlens.model import BLACKLISTED_STATUS, CLOSED_STATUS, NO_SLICE, Slice, Windows
from clientlens.operators import conform, kpis
from clientlens.operators.slices import VIEW_COLUMNS, as_number

ROWS_PER_FILE = 4096  # 16 MB of bitmaps; they shrink many times in a file, and what a task reads in one split comes out again at full size
KEYS = ("division", "country", "region", "sector")
WHO = {"all": "true", "registered": "client_ref > 0", "blacklisted": None, "closed": None}

# A set is (whose clients, "e" for enquiry, "j" for job or "u" for either, first day); a count is a sum of sizes of sets.
Set = tuple[str, str, date]
Count = list[tuple[int, Set]]


def _after(day: date) -> date:
    return day + timedelta(days=1)


def _between(who: str, column: str, first: date, last: date) -> Count:
    """Clients whose last date lies between two days, both included."""
    return [(1, (who, column, first)), (-1, (who, column, _after(max(last, first - timedelta(days=1)))))]


def _both(who: str, count: Count, since: date) -> Count:
    """Those of a count of jobs that have an enquiry since a day too: |J and E| = |J| + |E| - |J or E|."""
    out = []
    for sign, (_, _, first) in count:
        out += [(sign, (who, "j", first)), (sign, (who, "e", since)), (-sign, (who, "u", first))]
    return out


def _windows(w: Windows) -> dict[str, tuple[date, date]]:
    ever = date(9999, 12, 30)
    return {
        "total": (_after(w.floor), ever),
        "active": (w.active_from, w.active_to),
        "inactive": (w.inactive_from, w.inactive_to),
        "lost": (_after(w.floor), w.lost_to),
    }


def board_counts(w: Windows) -> dict[str, Count]:
    """K2 and K4, and the registered clients with history that K11 is a difference of."""
    since = _after(w.floor)
    out: dict[str, Count] = {}
    for name, (first, last) in _windows(w).items():
        out[f"enquiry_{name}"] = _between("all", "e", max(first, since), last)
        out[f"job_{name}"] = _both("all", _between("all", "j", first, last), since)
    for who in ("blacklisted", "closed"):
        out[f"enquiry_{who}"] = [(1, (who, "e", since))]
        out[f"job_{who}"] = _both(who, [(1, (who, "j", since))], since)
    out["seen_enquiry"] = [(1, ("registered", "e", since))]
    out["seen_job"] = [(1, ("registered", "j", since))]
    return out


def listing_counts(w: Windows) -> dict[str, Count]:
    """L8 of client listings: how many clients a listing of each kind has."""
    since, windows = _after(w.floor), _windows(w)
    return {
        "active_enq": _between("all", "e", *windows["active"]),
        "inactive_enq": _between("all", "e", *windows["inactive"]),
        "lost_enq": _between("all", "e", *windows["lost"]),
        "job_active": _between("all", "j", *windows["active"]),
        "job_inactive": _between("all", "j", *windows["inactive"]),
        "job_lost": _between("all", "j", *windows["lost"]),
        "total_job": _between("all", "j", since, w.active_to),
        "blacklisted_enq": [(1, ("blacklisted", "e", since))],
        "nonexisting_enq": [(1, ("closed", "e", since))],
        "job_blacklisted": [(1, ("blacklisted", "j", since))],
        "job_nonexisting": [(1, ("closed", "j", since))],
        "every": [(1, ("all", "e", w.floor))],
    }


def _needed(w: Windows) -> list[Set]:
    counts = [*board_counts(w).values(), *listing_counts(w).values()]
    return sorted({s for count in counts for _, s in count})


def _name(of: Set) -> str:
    return f"{of[0]}_{of[1]}_{of[2]}"


def client_number(ref: Column) -> Column:
    """A positive number for each client: even ones registered, odd ones temporary."""
    return F.when(ref > 0, 2 * ref).otherwise(1 - 2 * ref)


def client_sets(
    activity: DataFrame,
    client: DataFrame,
    w: Windows,
    keys: Sequence[str] = KEYS,
    blacklisted: Iterable[int] = BLACKLISTED_STATUS,
    closed: Iterable[int] = CLOSED_STATUS,
) -> DataFrame:
    """The table: the keys, which set, bucket and bitmap of its clients.

    The activity is reduced to one row per client and cell before its sets are told. All cells of a bucket are made by one task, a cell after the
    other: that is a bitmap for each set in memory, and rows of a bucket lie together where the table is written.
    """
    recent = kpis.live_activity(activity).filter(F.col("enquiry_date") >= F.lit(w.floor))
    recent = recent.withColumn("client_ref", conform.client_ref(F.col("debtor_no"), F.col("temp_client_id")))
    cells = (
        recent.filter(F.col("client_ref").isNotNull())
        .groupBy(*[as_number(recent, VIEW_COLUMNS[key]).cast("bigint").alias(key) for key in keys], "client_ref")
        .agg(F.max("enquiry_date").alias("e"), F.max("job_date").alias("j"))
    )
    statuses = client.select(
        F.col("debtor_no").cast("bigint").alias("client_ref"), F.col("client_status").cast("int").alias("status_id")
    )
    since = f"e >= DATE'{_after(w.floor)}'"
    who = {**WHO, "blacklisted": f"status_id IN ({sql.ids(blacklisted)})", "closed": f"status_id IN ({sql.ids(closed)})"}
    number, tests = client_number(F.col("client_ref")), {}
    for of in _needed(w):
        whose, column, first = of
        met = {"e": f"e >= DATE'{first}'", "j": f"j >= DATE'{first}'", "u": f"(j >= DATE'{first}' OR {since})"}[column]
        tests[_name(of)] = f"{who[whose]} AND {met}"
    members = cells.join(statuses, "client_ref", "left").select(
        *keys, F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).alias("position"), "client_ref", "e", "j", "status_id"
    )
    bitmaps = [F.bitmap_construct_agg(F.expr(f"IF({test}, position, NULL)")).alias(name) for name, test in tests.items()]
    held = [F.when(F.bitmap_count(name) > 0, F.struct(F.lit(name).alias("set"), F.col(name).alias("clients"))) for name in tests]
    return (
        # Clients are dealt out before there are bitmaps: what is sorted is a row for a client and cell, and no bitmap is shuffled.
        members.repartition("bucket")
        .groupBy("bucket", *keys)
        .agg(*bitmaps)
        .select(*keys, "bucket", F.explode(F.array_compact(F.array(*held))).alias("held"))
        .select(*keys, "held.set", "bucket", "held.clients")
    )


def merged_sets(*parts: DataFrame) -> DataFrame:
    """Tables of sets of several extracts put together."""
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy(*[c for c in rows.columns if c != "clients"]).agg(F.bitmap_or_agg("clients").alias("clients"))


def _sizes(sets: DataFrame, counts: Mapping[str, Count], by: Sequence[str]) -> DataFrame:
    """The counts for each value of some columns."""
    needed = sorted({_name(of) for count in counts.values() for _, of in count})
    united = (
        sets.filter(F.col("set").isin(*needed))
        .groupBy(*by, "set", "bucket")
        .agg(F.bitmap_or_agg("clients").alias("clients"))
        .select(*by, "set", F.bitmap_count("clients").alias("n"))
    )

    def total(count: Count) -> Column:
        weight: dict[str, int] = {}
        for sign, of in count:
            weight[_name(of)] = weight.get(_name(of), 0) + sign
        cases = " ".join(f"WHEN {sql.text(name)} THEN {sign}" for name, sign in weight.items())
        return F.expr(f"coalesce(sum(n * CASE set {cases} ELSE 0 END), 0)")

    return united.groupBy(*by).agg(*[total(count).alias(name) for name, count in counts.items()])


def _inside(sets: DataFrame, part: Slice) -> DataFrame:
    for key in VIEW_COLUMNS:
        wanted = getattr(part, key)
        if wanted is not None and key not in sets.columns:
            raise ValueError(f"the sets know no {key}")
        if wanted is not None:
            sets = sets.filter(F.col(key) == wanted)
    return sets


def listing_sizes(sets: DataFrame, w: Windows, part: Slice = NO_SLICE) -> DataFrame:
    """Rows (kind, entities) of the client listings of a slice."""
    counts = listing_counts(w)
    row = _sizes(_inside(sets, part), counts, [])
    pairs = ", ".join(f"{sql.text(kind)}, {sql.name(kind)}" for kind in counts)
    return row.selectExpr(f"stack({len(counts)}, {pairs}) AS (kind, entities)")


def sliced_counts(sets: DataFrame, w: Windows, slices: Sequence[Sequence[str]]) -> DataFrame:
    """K2, K4 and the idle clients of K11, for every slice of the given keys; a key that a slice leaves open is null."""
    keys = [key for key in VIEW_COLUMNS if key in sets.columns]
    around = [tuple(k for k in own if k in ("country", "region", "sector")) for own in slices]
    wanted = tuple(dict.fromkeys([*map(tuple, slices), *around]))
    counts = board_counts(w)
    pieces = []
    for own in wanted:
        known = reduce(lambda df, key: df.filter(F.col(key).isNotNull()), own, sets)
        named = [F.col(key) if key in own else F.lit(None).cast("bigint").alias(key) for key in keys]
        # one OR over the cells of each slice; the cells are read once for each set of keys, and are few
        pieces.append(_sizes(known, counts, list(own)).select(*named, *counts))
    boards = reduce(DataFrame.unionByName, pieces)
    place = [key for key in keys if key in ("country", "region", "sector")]
    ours = [key for key in keys if key not in place]
    outer = boards.filter(reduce(Column.__and__, [F.col(k).isNull() for k in ours], F.lit(True))).select(
        *[F.col(k).alias(f"_{k}") for k in place], F.col("seen_enquiry").alias("_e"), F.col("seen_job").alias("_j")
    )
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in place])
    asked = reduce(
        Column.__or__,
        [reduce(Column.__and__, [F.col(k).isNotNull() if k in own else F.col(k).isNull() for k in keys]) for own in slices],
    )
    return (
        boards.filter(asked)
        .join(outer, same, "left")
        .withColumns({"idle_enquiry": F.col("_e") - F.col("seen_enquiry"), "idle_job": F.col("_j") - F.col("seen_job")})
        .select(*keys, *[c for c in counts if not c.startswith("seen_")], "idle_enquiry", "idle_job")
    )
