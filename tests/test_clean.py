from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from clientlens.functions import compact_amount, safe_divide, safe_percent
from clientlens.operators import clean
from clientlens.operators.rankings import scaled


def column(df, name):
    return [row[name] for row in df.collect()]


def test_only_plain_days_are_dates(frame):
    texts = ["2024-01-01", "0000-00-00", "2024-01-01 10:00:00", "None", None]
    df = frame("due_date STRING, date_ STRING, note STRING", *[(t, t, t) for t in texts])
    out = clean.normalize_dates(df)
    expected = [date(2024, 1, 1), None, None, None, None]
    assert column(out, "due_date") == expected
    assert column(out, "date_") == expected
    assert column(out, "note") == texts


def test_timestamps_keep_only_midnight(frame):
    rows = [(datetime(2024, 1, 1),), (datetime(2024, 1, 1, 10),), (None,)]
    out = clean.normalize_dates(frame("added_date TIMESTAMP_NTZ", *rows))
    assert column(out, "added_date") == [date(2024, 1, 1), None, None]


def test_named_columns_are_normalized_whatever_their_suffix(frame):
    out = clean.normalize_dates(frame("day STRING", ("2024-02-30",), ("2024-02-29",)), ["day"])
    assert column(out, "day") == [None, date(2024, 2, 29)]


def test_numbers_fall_back_to_the_default(frame):
    df = frame("v STRING", ("12.5",), ("",), ("abc",), (None,), ("nan",), (" 7 ",))
    assert column(clean.coerce_numeric(df, ["v"]), "v") == [12.5, 0.0, 0.0, 0.0, 0.0, 7.0]
    assert column(clean.coerce_numeric(df, ["v"], -1.0), "v")[1:3] == [-1.0, -1.0]


def test_keys_are_trimmed_text(frame):
    df = frame("k STRING", (" 7 ",), ("nan",), ("7.0",), (None,))
    assert column(clean.normalize_key(df, "k"), "k") == ["7", None, "7.0", None]


def test_zero_fill(frame):
    df = frame(
        "d DOUBLE, n BIGINT, m DECIMAL(10,2), s STRING",
        (float("nan"), None, None, None),
        (float("inf"), 1, None, "x"),
        (float("-inf"), 2, None, "y"),
        (None, 3, None, "z"),
        (1.5, 4, None, "w"),
    )
    out = clean.zero_fill(df)
    assert column(out, "d") == [0.0, 0.0, 0.0, 0.0, 1.5]
    assert column(out, "n") == [0, 1, 2, 3, 4]
    assert [float(v) for v in column(out, "m")] == [0.0] * 5
    assert column(out, "s")[0] is None


def test_percent_of_nothing_is_zero(frame):
    df = frame("a DOUBLE, b DOUBLE", (1.0, 0.0), (1.0, None), (None, 2.0), (1.0, float("nan")), (1.0, 8.0))
    out = df.select(
        safe_percent(F.col("a"), F.col("b")).alias("p"), safe_divide(F.col("a"), F.col("b")).alias("r")
    )
    assert column(out, "p") == [0.0, 0.0, 0.0, 0.0, 12.5]
    assert column(out, "r") == [0.0, 0.0, 0.0, 0.0, 0.125]


def test_compact_amounts(frame):
    df = frame("v DOUBLE", (None,), (0.0,), (999.5,), (-1500.0,), (1234567.0,), (1000.0,), (1e6,), (347.905,))
    assert column(df.select(compact_amount(F.col("v")).alias("t")), "t") == [
        "0", "0", "999.50", "-1.5K", "1.23M", "1.0K", "1.00M", "347.91",
    ]


def test_small_amounts_survive_scaling(spark):
    """Scaled after summing: 1,000 amounts of 4,999 are 5.00 million, not 0."""
    df = spark.range(1000).select(F.lit(4999).cast("decimal(18,4)").alias("v"))
    assert df.agg(scaled(F.sum("v"), 1_000_000).alias("m")).first()["m"] == 5.0
