"""Bounded pieces of Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BYTES = 500_000  # of text worked on at once; a longer text is a piece of its own

ARROW_BATCH = "8m"  # of text that the JVM hands to a Python worker at once


def in_small_batches(df: DataFrame) -> DataFrame:
    """`df`, in a session that moves texts in small Arrow batches.

    Batches of Spark's default size take hundreds of megabytes beside the heap of an executor when its tasks hand over texts. The
    setting stays for the session, as the work is done later.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH)
    return df


def valid(text: Column) -> Column:
    """A text column that Python can decode: malformed UTF-8 becomes the replacement character, everything else stays as it is."""
    return F.make_valid_utf8(text)


def pieces(texts: pa.Array, limit: int = BYTES) -> Iterator[list[str | None]]:
    """The texts in order, in lists of at most `limit` characters of text, or of one text."""
    piece, size = [], 0
    for x in texts:
        text = x.as_py()
        n = len(text) if text else 0
        if piece and size + n > limit:
            yield piece
            piece, size = [], 0
        piece.append(text)
        size += n
    if piece:
        yield piece


def in_lists(sized: Iterable[tuple[int, object]], limit: int) -> Iterator[list]:
    """Things, given with their sizes, in lists whose sizes add up to the limit at most, or of one."""
    held, size = [], 0
    for n, x in sized:
        if held and size + n > limit:
            yield held
            held, size = [], 0
        held.append(x)
        size += n
    if held:
        yield held
