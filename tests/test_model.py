from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from clientlens import Slice, Windows
from clientlens.model import months_before
from clientlens.operators import slices

W = Windows(as_of=date(2024, 2, 29))


def test_months_before_clamps_to_the_month_end():
    assert months_before(date(2024, 3, 31), 1) == date(2024, 2, 29)
    assert months_before(date(2024, 1, 15), 1) == date(2023, 12, 15)
    assert months_before(date(2024, 2, 29), 12) == date(2023, 2, 28)
    assert months_before(date(2024, 1, 1), -1) == date(2024, 2, 1)


def matching(frame, kind, days):
    df = frame("d DATE", *[(d,) for d in days]).select(
        F.col("d").alias("enquiry_date"), F.col("d").alias("job_date"), F.lit(6).alias("status_id")
    )
    kept = slices.lifecycle_filter(df, kind, W)
    return sorted(r["enquiry_date"] for r in kept.collect())


@pytest.mark.parametrize(
    "kind, first, last",
    [
        ("active_enq", W.active_from, W.active_to),
        ("job_active", W.active_from, W.active_to),
        ("inactive_enq", W.inactive_from, W.inactive_to),
        ("job_inactive", W.inactive_from, W.inactive_to),
        ("lost_enq", W.floor + timedelta(days=1), W.lost_to),
        ("job_lost", W.floor + timedelta(days=1), W.lost_to),
        ("total_job", W.floor + timedelta(days=1), W.active_to),
    ],
)
def test_both_ends_of_a_segment_are_inside(frame, kind, first, last):
    day = timedelta(days=1)
    kept = matching(frame, kind, [first - day, first, first + day, last - day, last, last + day])
    assert kept == [first, first + day, last - day, last]


def test_every_segment_has_a_predicate(frame):
    for kind in (*slices.ENQUIRY_KINDS, *slices.JOB_KINDS, None):
        matching(frame, kind, [W.as_of])
    with pytest.raises(ValueError):
        slices.segment("nonsense", W)


def test_status_segments(frame):
    rows = [(date(2023, 6, 1), status) for status in (6, 2, 4, 11, 12, 1, None)]
    df = frame("enquiry_date DATE, status_id INT", *rows).withColumn("job_date", F.col("enquiry_date"))

    def statuses(kind):
        kept = slices.lifecycle_filter(df, kind, W)
        return sorted(r["status_id"] for r in kept.collect())

    assert statuses("blacklisted_enq") == statuses("job_blacklisted") == [6]
    assert statuses("nonexisting_enq") == statuses("job_nonexisting") == [2, 4, 11, 12]


def test_unparsable_keys_never_match_a_slice(frame):
    df = frame("country STRING", ("1",), (" 1 ",), ("",), ("x",), (None,), ("10",))
    assert slices.slice_by(df, Slice(country=1), {"country": "country"}).count() == 2


def test_the_complement_leaves_null_out(frame):
    df = frame("division INT, sub_division INT", (3, 1), (4, 1), (4, 2), (None, 2))
    assert slices.exclude_other_slice(df, 3).count() == 2
    assert slices.exclude_other_slice(df, 3, 1).count() == 1
    assert slices.exclude_other_slice(df).count() == 4


def test_null_is_outside_a_slice(frame):
    df = frame("division INT, sub_division INT", (3, None), (3, 1), (None, 1))
    here = df.select(F.expr(slices.inside(Slice(division=3, subdivision=1))).alias("here"))
    assert [r["here"] for r in here.collect()] == [False, True, False]
