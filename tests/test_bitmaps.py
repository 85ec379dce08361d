"""Counts of distinct clients from merged bitmaps against counts from the activity."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F
from test_plans import plan

from clientlens.model import NO_SLICE, Slice, Windows
from clientlens.operators import bitmaps, kpis, listings
from clientlens.plans.mapping import AS_OF, FLOOR, WINDOWS

ALL_KEYS = ("division", "subdivision", "country", "region", "sector")


@pytest.fixture(scope="module")
def sets(sample):
    """Cells of all five keys."""
    return bitmaps.client_sets(sample["client_activity"], sample["client"], WINDOWS, ALL_KEYS).cache()


PARTS = [NO_SLICE, Slice(division=3), Slice(division=3, subdivision=107), Slice(country=6, sector=2), Slice(region=2),
         Slice(division=225, region=1), Slice(division=3, country=6, sector=2), Slice(division=999)]


@pytest.mark.parametrize("part", PARTS)
def test_board_counts_of_any_slice(part, sets, sample):
    wanted = kpis.client_board(sample["client_activity"], sample["client"], WINDOWS, part).first().asDict()
    inside = bitmaps._inside(sets, part)
    got = bitmaps._sizes(inside, bitmaps.board_counts(WINDOWS), []).first()
    here = got.asDict() if got else {}
    around = bitmaps._sizes(bitmaps._inside(sets, part.only("country", "region", "sector")), bitmaps.board_counts(WINDOWS), []).first()
    for kind in ("enquiry", "job"):
        here[f"idle_{kind}"] = around[f"seen_{kind}"] - here[f"seen_{kind}"]
    assert {name: here[name] for name in wanted} == wanted


@pytest.mark.parametrize("part", PARTS[:5])
def test_listing_counts_of_any_slice(part, sets, sample):
    got = {r["kind"]: r["entities"] for r in bitmaps.listing_sizes(sets, WINDOWS, part).collect()}
    for kind in got:
        listed = listings.listed_clients(sample, WINDOWS, None if kind == "every" else kind, part)
        assert listings.listing_count(listed).first()["entities"] == got[kind], kind


@pytest.mark.parametrize("w", [Windows(as_of=date(1996, 3, 1), floor=FLOOR), Windows(as_of=AS_OF, floor=date(2001, 6, 1)), Windows(as_of=date(1990, 1, 1), floor=FLOOR)])
def test_windows_that_overlap_the_floor(w, sample):
    """Lost before the floor, active before the floor, and everything before the data."""
    own = bitmaps.client_sets(sample["client_activity"], sample["client"], w, ())
    got = bitmaps._sizes(own, bitmaps.board_counts(w), []).first().asDict()
    wanted = kpis.client_board(sample["client_activity"], sample["client"], w).first().asDict()
    assert {n: got[n] for n in wanted if not n.startswith("idle")} == {n: v for n, v in wanted.items() if not n.startswith("idle")}


def test_tables_of_two_extracts_merge(sample, sets):
    early = F.col("enquiry_date") < F.lit(date(1998, 1, 1))
    parts = [
        bitmaps.client_sets(sample["client_activity"].filter(test), sample["client"], WINDOWS, ("division",)) for test in (early, ~early)
    ]
    whole = bitmaps.client_sets(sample["client_activity"], sample["client"], WINDOWS, ("division",))
    rows = lambda df: sorted((r["division"], r["set"], r["bucket"], bytes(r["clients"])) for r in df.collect())
    assert rows(bitmaps.merged_sets(*parts)) == rows(whole)


def test_registered_and_temporary_clients_have_numbers_of_their_own(spark):
    refs = spark.range(-70_000, 70_001).filter("id <> 0").select(bitmaps.client_number(F.col("id")).alias("n"))
    assert refs.agg(F.count_distinct("n"), F.min("n")).first()[:] == (140_000, 2)


def test_a_slice_of_an_unknown_key_is_refused(sample):
    own = bitmaps.client_sets(sample["client_activity"], sample["client"], WINDOWS, ("division",))
    with pytest.raises(ValueError, match="no country"):
        bitmaps.listing_sizes(own, WINDOWS, Slice(country=6))


def test_counts_read_the_table_only(sets, sample):
    assert "Aggregate" in plan(bitmaps.listing_sizes(sets, WINDOWS), "simple")
    assert "Expand" not in plan(bitmaps.listing_sizes(sets, WINDOWS), "simple")  # no distinct count left


def test_no_bitmap_is_shuffled_when_sets_are_made(sample):
    """Clients are dealt by bucket once; what follows the first bitmaps is one task's."""
    text = plan(bitmaps.client_sets(sample["client_activity"], sample["client"], WINDOWS), "simple")
    made = text[: text.rindex("bitmap_construct_agg")]
    assert "bitmap_construct_agg" in made and "Exchange" not in made


def test_empty_sets_are_not_stored(spark):
    activity = spark.sql(
        "SELECT bigint(5) AS debtor_no, bigint(0) AS temp_client_id, 3 AS division, 1 AS sub_division, 1 AS country_id, 1 AS region_id, "
        "2 AS client_type, DATE'1996-05-01' AS enquiry_date, CAST(NULL AS DATE) AS job_date"
    )
    client = spark.sql("SELECT bigint(5) AS debtor_no, 1 AS client_status")
    found = bitmaps.client_sets(activity.unionAll(activity), client, WINDOWS, ("division",)).select("set", F.bitmap_count("clients").alias("n")).collect()
    assert found and all(r["n"] == 1 for r in found) and len({r["set"] for r in found}) == len(found)
    assert not [r for r in found if "_j_" in r["set"] or r["set"].startswith(("blacklisted", "closed"))]
