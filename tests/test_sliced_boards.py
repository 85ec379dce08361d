"""The boards of many slices against the board of each slice."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from test_plans import plan, scanned

from clientlens.model import NO_SLICE, Slice
from clientlens.plans.board import whole_board
from clientlens.plans.mapping import WINDOWS
from clientlens.plans.sliced_boards import KEYS, UP_TO_TWO_KEYS, activity_code_boards, board_of, client_boards, sliced_boards


@pytest.fixture(scope="module")
def boards(spark, snapshots):
    found = sliced_boards(snapshots, WINDOWS)
    return {tuple(r[k] for k in KEYS): r for r in found.collect()}


def test_each_equals_the_board_of_its_slice(boards, snapshots):
    rng = random.Random(1)
    picked = [(None,) * 5, *rng.sample([k for k in boards if sum(x is not None for x in k) == 1], 5)]
    picked += rng.sample([k for k in boards if sum(x is not None for x in k) == 2], 8)
    for key in picked:
        own = whole_board(snapshots, WINDOWS, Slice(**dict(zip(KEYS, key)))).first().asDict()
        assert {c: boards[key][c] for c in own} == own, key
        assert set(boards[key].asDict()) == set(own) | set(KEYS)


def test_all_slices_of_one_and_two_keys_are_listed(boards):
    kinds = {tuple(x is not None for x in key) for key in boards}
    assert len(kinds) == 16 and all(sum(k) <= 2 for k in kinds)
    assert len(boards) == len({k for k in boards})


def test_chosen_sets_only(snapshots):
    """Without the place itself among the sets, what is idle in a division of it still counts."""
    found = sliced_boards(snapshots, WINDOWS, [("division", "region")]).filter("division = 3 AND region = 2").collect()
    (row,) = found
    own = whole_board(snapshots, WINDOWS, Slice(division=3, region=2)).first().asDict()
    assert {c: row[c] for c in own} == own
    with pytest.raises(ValueError, match="no keys"):
        sliced_boards(snapshots, WINDOWS, [("division", "city")])


def test_rows_without_a_key_are_in_no_slice_of_it(sample):
    tables = {n: sample[n] for n in ("client", "country", "job_activity", "client_activity", "activity_code_activity", "invoice")}
    tables["enquiry"] = sample["enquiry"].withColumn("division", F.when(F.col("division") != 3, F.col("division")))
    found = sliced_boards(tables, WINDOWS, [(), ("division",)])
    company = board_of(found, NO_SLICE).first()
    whole = whole_board({**tables, "region": sample["region"]}, WINDOWS).first().asDict()
    assert {c: company[c] for c in whole} == whole
    divisions = [r["division"] for r in found.filter("division IS NOT NULL").collect()]
    assert sorted(divisions) == [3, 10, 11, 12, 225]
    assert board_of(found, Slice(division=3)).first()["amount_enquiry_current"] == 0


def test_each_fact_is_scanned_once(snapshots):
    scans = scanned(sliced_boards(snapshots, WINDOWS))
    assert scans.count("enquiry") == scans.count("invoice") == scans.count("activity_code_activity") == 1
    assert scans.count("client_activity") == 2  # by country and by client
    # facts are reduced before they are multiplied by the sets
    text = plan(sliced_boards(snapshots, WINDOWS), "simple")
    for below in text.split("Expand")[1:]:
        assert "HashAggregate" in below.split("FileScan")[0]


def test_slices_of_many_entities_are_not_moved(spark, snapshots):
    """Rows are dealt by entity, in a fixed number of tasks, before the sets multiply them; then only figures of slices move."""
    t, sets = snapshots, UP_TO_TWO_KEYS
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for boards in (
        client_boards(t["client_activity"], t["client"], WINDOWS, sets),
        activity_code_boards(t["activity_code_activity"], t["job_activity"], t["country"], WINDOWS, sets),
    ):
        text = plan(boards, "simple")
        assert "Expand" not in text
        figures, dealt = text.split("REPARTITION_BY_NUM")[0].split("BroadcastNestedLoopJoin")
        assert figures.count("Exchange") == 1 and "hashpartitioning(entity" in dealt and f", {2 * partitions})" in dealt
