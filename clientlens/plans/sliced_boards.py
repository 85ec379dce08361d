"""K13 for many slices at once: the boards of all slices of one or two keys from one pass over each fact.

A board is made of figures over entities (countries, clients, activity codes) and of sums of amounts. Both have states that can be merged: the last
date of an entity, and a sum. Facts are first reduced to one state per entity and cell, a cell being a combination of division, sub-division, country,
region and sector. Cells are then merged into slices, and only what is left of a fact after the first reduction is multiplied by the number of
sets: by grouping sets where the cells are few, and inside tasks that hold all cells of an entity where there is no bound to the entities.

Idle counts need no set of their own. What a slice has not seen but its place and sector have is the difference of two counts of history, that
of the slice without its divisions less its own, since whoever has history in the slice has it around it too.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientlens.functions import sql
from clientlens.model import (
    BLACKLISTED_STATUS,
    CLOSED_STATUS,
    DIVISION_NAMES,
    EXCLUDED_SECTOR,
    SECTORS,
    Slice,
    Windows,
)
from clientlens.operators import conform, kpis
from clientlens.operators.slices import VIEW_COLUMNS, as_number, between_dates, has_history

KEYS = tuple(VIEW_COLUMNS)  # division, subdivision, country, region, sector
PLACE = ("country", "region", "sector")
Sets = Sequence[tuple[str, ...]]

#: The company and every slice of one or two keys.
UP_TO_TWO_KEYS: Sets = tuple(keys for n in range(3) for keys in combinations(KEYS, n))


def _keys(df: DataFrame, columns: Mapping[str, str]) -> list[Column]:
    return [as_number(df, columns[key]).cast("bigint").alias(f"s_{key}") for key in KEYS]


_SLICE = [f"s_{key}" for key in KEYS]


def _merged(cells: DataFrame, sets: Sets, entity: Iterable[str], states: list[Column]) -> DataFrame:
    """Cells merged into slices: one row for each slice and entity. A key that a slice leaves open is null."""
    entity = list(entity)
    grouped = cells.groupingSets(
        [[F.col(f"s_{key}") for key in keys] + [F.col(e) for e in entity] for keys in sets],
        *[F.col(c) for c in (*_SLICE, *entity)],
    ).agg(*states, *[F.grouping(F.col(c)).alias(f"open_{c}") for c in _SLICE])
    # a null that is not an open key is a row without it, which is in no slice of that key
    named = reduce(Column.__and__, [(F.col(f"open_{c}") == 1) | F.col(c).isNotNull() for c in _SLICE])
    return grouped.filter(named).drop(*[f"open_{c}" for c in _SLICE])


def _merged_in_place(cells: DataFrame, sets: Sets, entity: str, states: list[Column]) -> DataFrame:
    """The same for many entities. All cells of an entity are dealt to one task, so what the sets multiply is not moved.

    Cells are small when they are dealt and many once multiplied, so there are more tasks than for other shuffles, and AQE, which knows the
    cells alone, does not merge them.
    """
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")) * max(1, len(sets) // 8)
    # A set as a number, a bit for each key: a row is repeated for each and then loses the keys that the set leaves open.
    numbers = sorted({sum(1 << i for i, key in enumerate(KEYS) if key in keys) for keys in sets})
    taken = [F.col("of").bitwiseAND(1 << i) != 0 for i in range(len(KEYS))]
    named = reduce(Column.__and__, [~held | F.col(c).isNotNull() for held, c in zip(taken, _SLICE)])
    listed = cells.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(f'({n})' for n in numbers)} AS t(of)")
    repeated = cells.repartition(tasks, entity).crossJoin(listed).filter(named)
    return repeated.withColumns({c: F.when(held, F.col(c)) for held, c in zip(taken, _SLICE)}).groupBy(*_SLICE, entity).agg(*states)


def _latest(*also: str) -> list[Column]:
    return [F.max(c).alias(c) for c in ("enquiry_date", "job_date", *also)]


def _last_days(rows: DataFrame, entity: Column) -> DataFrame:
    """Cells of the last days of an entity."""
    return rows.groupBy(*_SLICE, entity.alias("entity")).agg(*_latest())


def _board_of(last: DataFrame, figures: list[Column]) -> DataFrame:
    return last.groupBy(*_SLICE).agg(*figures)


def country_boards(activity: DataFrame, w: Windows, sets: Sets) -> DataFrame:
    """K1 of every slice, with the counts that K11 needs."""
    live = kpis.live_activity(activity)
    cells = _last_days(live.select("*", *_keys(live, VIEW_COLUMNS)), F.col("country_id"))
    last = _merged(cells, sets, ["entity"], _latest())
    return _board_of(
        last,
        [
            F.count("*").alias("countries"),
            *kpis.lifecycle("enquiry_date", w, "enquiry"),
            *kpis.lifecycle("job_date", w, "job"),
            *kpis.counts(seen_enquiry=has_history("enquiry_date", w), seen_job=has_history("job_date", w)),
        ],
    )


def client_boards(activity: DataFrame, client: DataFrame, w: Windows, sets: Sets) -> DataFrame:
    """K2 and K4 of every slice, with the counts of registered clients that K11 needs."""
    recent = kpis.live_activity(activity).filter(F.col("enquiry_date") >= F.lit(w.floor))
    ref = conform.client_ref(F.col("debtor_no"), F.col("temp_client_id"))
    cells = _last_days(recent.select("*", *_keys(recent, VIEW_COLUMNS)), ref).filter(F.col("entity").isNotNull())
    statuses = client.select(
        F.col("debtor_no").cast("bigint").alias("entity"), F.col("client_status").cast("int").alias("status_id")
    )
    last = _merged_in_place(cells.join(statuses, "entity", "left"), sets, "entity", _latest("status_id"))
    since = has_history("enquiry_date", w)
    return _board_of(
        last,
        [
            *kpis.lifecycle("enquiry_date", w, "enquiry", since),
            *kpis.lifecycle("job_date", w, "job", since),
            *kpis.status_counts("enquiry_date", "job_date", w, BLACKLISTED_STATUS, CLOSED_STATUS),
            *kpis.counts(
                seen_enquiry=f"entity > 0 AND {has_history('enquiry_date', w)}",
                seen_job=f"entity > 0 AND {has_history('job_date', w)}",
            ),
        ],
    )


def activity_code_boards(
    code_activity: DataFrame, job_activity: DataFrame, country: DataFrame, w: Windows, sets: Sets
) -> DataFrame:
    """K3 of every slice: place and sector are those of the activity, divisions those of the code."""
    regions = country.select(F.col("id").alias("country_id"), F.col("region_id"))
    used = code_activity.filter(F.col("client_type") != EXCLUDED_SECTOR)
    reduced = used.groupBy("activity_code", "country_id", "client_type").agg(*_latest())
    live = job_activity.filter((F.col("activity_code") != "") & (F.col("status") == 1)).select(
        "activity_code", "division_id", "sub_division_id"
    )
    placed = reduced.join(live.distinct(), "activity_code").join(regions, "country_id", "left")
    columns = {**VIEW_COLUMNS, "division": "division_id", "subdivision": "sub_division_id"}
    cells = _last_days(placed.select("*", *_keys(placed, columns)), F.col("activity_code"))
    last = _merged_in_place(cells, sets, "entity", _latest())
    since = f"enquiry_date >= DATE'{w.floor}'"
    return _board_of(
        last, [*kpis.lifecycle("enquiry_date", w, "enquiry", since), *kpis.lifecycle("job_date", w, "job", since)]
    )


def _amounts(cells: DataFrame, sets: Sets, amounts: Sequence[str], *figures: kpis.Figures) -> DataFrame:
    """Sums by slice, division and sector, and the figures over them; `shown` is what shares of divisions are of."""
    totals = _merged(cells, sets, ["division", "client_type"], [F.sum(a).alias(a) for a in amounts])
    is_open = reduce(Column.__and__, [F.col(c).isNull() for c in _SLICE])
    if "active" in amounts:
        # amounts by division count transfers on the company's board only
        totals = totals.withColumn("shown", F.when(is_open, F.col("active")).otherwise(F.col("current")))
    sums = totals.groupBy(*_SLICE).agg(*[a for aggregates, _ in figures for a in aggregates])
    return sums.select(*_SLICE, *[c.alias(name) for _, named in figures for name, c in named.items()])


def _located(df: DataFrame, client: DataFrame, country: DataFrame, sector: bool) -> DataFrame:
    known = client.select(
        F.col("debtor_no").cast("bigint").alias("debtor_no"),
        F.col("country").cast("int").alias("country_id"),
        *([F.col("client_type").cast("int").alias("client_type")] if sector else []),
    )
    regions = country.select(F.col("id").alias("country_id"), "region_id")
    return df.join(known, "debtor_no", "left").join(regions, "country_id", "left")


def enquiry_boards(
    enquiry: DataFrame,
    client: DataFrame,
    country: DataFrame,
    w: Windows,
    sets: Sets,
    divisions: Mapping[int, str] = DIVISION_NAMES,
    sectors: Mapping[int, str] = SECTORS,
) -> DataFrame:
    """K5, K7 and K8 of every slice."""
    amounts = ("previous", "current", "active")
    sums = kpis.enquiry_sums(enquiry, w, "debtor_no", "division", "subdivision", "client_type")
    placed = _located(sums, client, country, sector=False)
    keyed = placed.select(*_keys(placed, {**VIEW_COLUMNS, "subdivision": "subdivision"}), "division", "client_type", *amounts)
    cells = keyed.groupBy(*_SLICE, "division", "client_type").agg(*[F.sum(a).alias(a) for a in amounts])
    return _amounts(
        cells,
        sets,
        amounts,
        kpis.enquiry_growth_figures(),
        kpis.enquiry_share_figures(divisions, source="shown"),
        kpis.sector_figures("enquiry", "active", sectors),
    )


def invoice_boards(
    invoice: DataFrame,
    client: DataFrame,
    country: DataFrame,
    w: Windows,
    sets: Sets,
    divisions: Mapping[int, str] = DIVISION_NAMES,
    sectors: Mapping[int, str] = SECTORS,
) -> DataFrame:
    """K6, K9 and K10 of every slice."""
    amounts = ("previous_net", "current_net", "previous_gross", "current_gross")
    sums = kpis.invoice_sums(invoice, w, "debtor_no", F.col("dimension2_id").alias("division"), F.col("dimension3_id").alias("subdivision"))
    placed = _located(sums, client, country, sector=True).filter(F.col("client_type") != EXCLUDED_SECTOR)
    keyed = placed.select(*_keys(placed, {**VIEW_COLUMNS, "subdivision": "subdivision"}), "division", "client_type", *amounts)
    cells = keyed.groupBy(*_SLICE, "division", "client_type").agg(*[F.sum(a).alias(a) for a in amounts])
    return _amounts(
        cells,
        sets,
        amounts,
        kpis.invoice_growth_figures(),
        kpis.invoice_share_figures(divisions),
        kpis.sector_figures("invoice", "current_net", sectors),
    )


def sliced_boards(
    tables: Mapping[str, DataFrame],
    w: Windows,
    sets: Sets = UP_TO_TWO_KEYS,
    divisions: Mapping[int, str] = DIVISION_NAMES,
    sectors: Mapping[int, str] = SECTORS,
) -> DataFrame:
    """One row for each slice: its five keys, null where open, and all figures of its board as DOUBLE.

    `sets`: which keys slices are made of. Listed is every slice that some fact has a row in; the board of any other one is all
    zeros but for what is idle there. Each figure equals that of `kpi_metrics` for the slice.
    """
    unknown = {key for keys in sets for key in keys} - set(KEYS)
    if unknown:
        raise ValueError(f"no keys of a slice: {sorted(unknown)}")
    t, around = tables, [tuple(k for k in keys if k in PLACE) for keys in sets]
    wanted = tuple(dict.fromkeys([*map(tuple, sets), *around]))
    pieces = [
        ("country", country_boards(t["client_activity"], w, wanted)),
        ("client", client_boards(t["client_activity"], t["client"], w, wanted)),
        ("activity", activity_code_boards(t["activity_code_activity"], t["job_activity"], t["country"], w, wanted)),
        ("amount", enquiry_boards(t["enquiry"], t["client"], t["country"], w, wanted, divisions, sectors)),
        ("amount", invoice_boards(t["invoice"], t["client"], t["country"], w, wanted, divisions, sectors)),
    ]
    named = []
    for prefix, piece in pieces:
        figures = [c for c in piece.columns if c not in _SLICE]
        named.append(piece.select(*_SLICE, *[F.col(sql.name(c)).cast("double").alias(f"{prefix}_{c}") for c in figures]))
    figures = [c for piece in named for c in piece.columns if c not in _SLICE]
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)
    boards = together.groupBy(*_SLICE).agg(*[F.coalesce(F.max(sql.name(c)), F.lit(0.0)).alias(c) for c in figures])

    # The slice around each one: the same place and sector, all divisions. A window holds the divisions and sub-divisions of a place.
    without = F.col("s_division").isNull() & F.col("s_subdivision").isNull()
    around_it = Window.partitionBy(*[f"s_{key}" for key in PLACE])
    for entity in ("country", "client"):
        for kind in ("enquiry", "job"):
            seen = F.col(f"{entity}_seen_{kind}")
            boards = boards.withColumn(f"{entity}_idle_{kind}", F.max(F.when(without, seen)).over(around_it) - seen)
    hidden = [f"{entity}_seen_{kind}" for entity in ("country", "client") for kind in ("enquiry", "job")]
    asked = F.lit(False)
    for keys in sets:
        asked = asked | reduce(
            Column.__and__, [F.col(f"s_{key}").isNotNull() if key in keys else F.col(f"s_{key}").isNull() for key in KEYS]
        )
    return boards.filter(asked).drop(*hidden).withColumnsRenamed({f"s_{key}": key for key in KEYS})


def board_of(boards: DataFrame, part: Slice) -> DataFrame:
    """The row of one slice."""
    tests = [F.col(k).isNull() if getattr(part, k) is None else F.col(k) == getattr(part, k) for k in KEYS]
    return boards.filter(reduce(Column.__and__, tests))
