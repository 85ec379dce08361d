"""Exact duplicates by a Golomb-coded exchange of fingerprints.

Each partition sorts the distinct 64-bit fingerprints of its texts and sends them, as Golomb-coded
gaps, to the owners of the fingerprint ranges. An owner answers each list with a bitmap: which of these does another
partition hold too? With the bitmap, and with what it sees twice itself, a partition knows its suspects. Only
suspects' texts are shuffled, to be compared byte by byte; all other texts stay where they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import Scan, partition_sizes, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def golomb_encode(values: np.ndarray) -> tuple[int, int, bytes]:
    """(first value, bits of the remainder, coded gaps) of a sorted array of distinct unsigned 64-bit values.

    A gap is written as its quotient by 2**bits in unary (that many ones, then a zero), and all remainders follow
    as plain bits; the divisor is the power of two nearest below the mean gap, which is near the best for gaps of
    random values.
    """
    values = np.asarray(values, dtype=np.uint64)
    gaps = np.diff(values)
    if not len(gaps):
        return int(values[0]) if len(values) else 0, 0, b""
    bits = max(0, int(int(values[-1] - values[0]) // len(gaps)).bit_length() - 1)
    quotients = (gaps >> np.uint64(bits)).astype(np.int64)
    unary = np.ones(int(quotients.sum()) + len(gaps), dtype=np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 0
    places = np.arange(bits, dtype=np.uint64)
    rest = ((gaps[:, None] >> places) & np.uint64(1)).astype(np.uint8).ravel()
    return int(values[0]), bits, np.packbits(np.concatenate([unary, rest])).tobytes()


def golomb_decode(n: int, first: int, bits: int, coded: bytes) -> np.ndarray:
    """The `n` values that `golomb_encode` was given."""
    if n <= 1:
        return np.array([first][:n], dtype=np.uint64)
    stream = np.unpackbits(np.frombuffer(coded, dtype=np.uint8))
    ends = np.flatnonzero(stream == 0)[: n - 1]
    quotients = np.diff(ends, prepend=-1) - 1
    rest = stream[ends[-1] + 1 :][: (n - 1) * bits].reshape(n - 1, bits).astype(np.uint64)
    low = (rest << np.arange(bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    gaps = (quotients.astype(np.uint64) << np.uint64(bits)) | low
    return np.concatenate([[np.uint64(first)], np.uint64(first) + np.cumsum(gaps, dtype=np.uint64)])


def normalised(text: Column) -> Column:
    """Null as empty, A-Z in lower case, everything else as it is."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _lists(owners: int):
    """A partition's fingerprints become one coded list for each owner that has some."""

    def lists(rows):
        part, prints = int(rows["part"].iloc[0]), np.unique(rows["mark"].to_numpy().view(np.uint64))
        owner, sent = prints // np.uint64(2**64 // owners + 1), []
        for at in np.unique(owner):
            own = prints[owner == at]
            first, bits, coded = golomb_encode(own)
            sent.append((part, int(at), len(own), int(np.uint64(first).view(np.int64)), bits, coded))
        return pd.DataFrame(sent, columns=["part", "owner", "n", "first", "bits", "coded"])

    return lists


def _decoded(lists) -> list[np.ndarray]:
    return [
        golomb_decode(n, int(np.int64(first).view(np.uint64)), bits, coded)
        for n, first, bits, coded in zip(lists["n"], lists["first"], lists["bits"], lists["coded"])
    ]


def _bitmaps(lists):
    """An owner's answer to each list: bit i is set if another partition's list has this one's value i too."""
    values = _decoded(lists)
    distinct, counts = np.unique(np.concatenate(values), return_counts=True)
    shared = [np.packbits(np.isin(v, distinct[counts > 1], assume_unique=True)).tobytes() for v in values]
    return lists.assign(shared=shared)


def _suspects(rows, lists):
    """A partition's rows whose fingerprint another partition holds, or that share one among themselves."""
    shared = [v[np.unpackbits(np.frombuffer(b, np.uint8), count=len(v)) == 1] for v, b in zip(_decoded(lists), lists["shared"])]
    prints = rows["mark"].to_numpy().view(np.uint64)
    return rows[np.isin(prints, np.concatenate(shared)) | rows["mark"].duplicated(keep=False).to_numpy()]


def find_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owners: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and its part, place and mark.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the
    largest id stays; a null id counts as the smallest, and of rows with one id and text a single one stays. Other
    columns are not read, whatever their names. An empty table gives no rows. `owners`: into how many ranges
    fingerprints are dealt (by default the session's shuffle partitions).

    A group may hold any share of all rows: a partition sends a fingerprint once, and the comparison groups by the
    text itself, so that each task reduces its copies to one row before the shuffle.
    """
    spark = docs.sparkSession
    owners = owners or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = normalised(F.col(text_col))
    base = docs.select(
        F.xxhash64(text).alias("mark"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.unhex(F.sha2(text, 256)).alias("sha"),
        text.alias("text"),
    )
    scan = Scan(base)
    rows = stored(scan.places("doc_id", "sha"), "rows")  # all but the texts
    by_part = rows.select("part", "place", "mark").groupBy("part")
    lists = "part int, owner int, n int, first long, bits int, coded binary"
    sent = by_part.applyInPandas(_lists(owners), lists)
    answered = sent.groupBy("owner").applyInPandas(_bitmaps, lists + ", shared binary")
    suspects = by_part.cogroup(answered.groupBy("part")).applyInPandas(_suspects, "part int, place long, mark long")

    sizes = partition_sizes(rows)
    alike = (
        spark.createDataFrame(
            scan.attach(suspects, sizes).filter(lambda pair: pair[1] is not None).map(lambda pair: pair[0]), scan.df.schema, verifySchema=False
        )
        # grouping by the text compares its bytes
        .groupBy("sha", "text")
        .agg(
            F.count("*").alias("group_size"),
            F.max("doc_id").alias("keep_id"),
            F.coalesce(F.max_by("row", "doc_id"), F.max("row")).alias("keep_row"),
        )
        .filter("group_size > 1")
        .drop("text")
    )
    return rows.join(stored(alike, "groups"), "sha", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "part",
        "place",
        "mark",
    )
