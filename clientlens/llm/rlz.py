"""Repeated passages by relative Lempel-Ziv parsing.

The reference is all the text that comes before a window of words: smaller ids, and earlier in the same text. Its index holds
windows, dealt in blocks by hash, with the smallest id that each occurs in. A text is parsed greedily against all blocks: a factor goes on as long
as the next window stands in the index with the same reference, and every window that crosses the end of a factor is looked up too. A factor
is at least a window long, and its words are the repeated ones.

Most windows occur once and never reach the index. Of its runs of SEED words, a window selects the one with the smallest hash, so equal
windows select equal seeds. Only windows whose seed occurs in another text are indexed. Texts that repeat an earlier text as a whole are
known from their hashes and not indexed at all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import Scan, partition_sizes, stored
from .words import Hasher, batched, grams

WINDOW = 20  # words
SEED = 8
FIRST = -(2**63)  # stands for a null id


def least(x: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each n successive numbers."""
    size = 1
    while 2 * size <= n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def seeds(words: np.ndarray) -> np.ndarray:
    """The seed of each window of some words, which may be of several texts."""
    return least(grams(words, SEED), WINDOW - SEED + 1) if len(words) >= WINDOW else np.empty(0, dtype=np.uint64)


def per_text(windows: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """What `windows` says about the windows inside each text."""
    starts = np.cumsum(counts) - counts
    return [windows[s : s + max(0, n - WINDOW + 1)] for s, n in zip(starts.tolist(), counts.tolist())]


def _batches(pairs: Iterable, hasher: Hasher) -> Iterator[tuple]:
    """Rows with their answers, the words of their texts, and how many each has."""
    for batch in batched(pairs, lambda p: len(p[0][1] or "")):
        yield batch, *hasher.texts([(row[1] or "").encode() for row, _ in batch])


def _seeds(pairs: Iterable) -> Iterator[tuple]:
    """row and its distinct seeds, of texts that are no copies."""
    for batch, words, counts in _batches((p for p in pairs if p[1] is None), Hasher()):
        for (row, _), own in zip(batch, per_text(seeds(words), counts)):
            if len(own):
                yield row[3], bytearray(np.unique(own).tobytes())


def _windows(pairs: Iterable) -> Iterator[tuple]:
    """row, id, and the places and hashes of its windows whose seeds other texts have; of equal ones the first."""
    for batch, words, counts in _batches((p for p in pairs if p[1] is not None), Hasher()):
        long_enough = len(words) >= WINDOW
        one, two = (grams(words, WINDOW, k) if long_enough else words[:0] for k in (2, 3))
        for (row, answer), own, a, b in zip(batch, *(per_text(x, counts) for x in (seeds(words), one, two))):
            at = np.flatnonzero(np.isin(own, np.array(answer[0], dtype=np.int64).view(np.uint64)))
            at = np.sort(at[np.unique(a[at], return_index=True)[1]])
            yield row[3], FIRST if row[2] is None else row[2], bytearray(at.astype(np.int32).tobytes()), bytearray(a[at].tobytes()), bytearray(b[at].tobytes())


def _unpacked(kinds: dict[str, str]):
    """Rows of a table whose binary columns, named with their types, hold many values each."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            out, sizes = {}, None
            for name, kind in kinds.items():
                packed = [x.as_buffer() for x in batch.column(names.index(name))]
                values = [np.frombuffer(p, dtype=kind) for p in packed]
                sizes = [len(v) for v in values]
                out[name] = np.concatenate(values) if values else np.empty(0, dtype=kind)
            once = {n: np.repeat(batch.column(names.index(n)).to_numpy(), sizes or 0) for n in names if n not in kinds}
            arrays = once | out
            yield pa.RecordBatch.from_arrays([pa.array(arrays[n]) for n in names], names=names)

    return unpack


def factors(at: np.ndarray, references: np.ndarray) -> list[tuple[int, int, int]]:
    """Greedy factors (first word, end, reference) of indexed windows at increasing places."""
    if not len(at):
        return []
    breaks = np.flatnonzero((np.diff(at) != 1) | (references[1:] != references[:-1])) + 1
    begin, end = np.append(0, breaks), np.append(breaks, len(at)) - 1
    return list(zip(at[begin].tolist(), (at[end] + WINDOW).tolist(), references[begin].tolist()))


def _removed(pairs: Iterable) -> Iterator[tuple]:
    """The result of each row; see `remove_repeats`."""
    for batch, words, counts in _batches(pairs, Hasher()):
        every = per_text(grams(words, WINDOW, 2) if len(words) >= WINDOW else words[:0], counts)
        for (row, answer), own in zip(batch, every):
            text = (row[1] or "").encode().split()
            here = FIRST if row[2] is None else row[2]
            copy_of, found, known = answer if answer is not None else (None, None, None)
            if copy_of is not None:
                at, references = np.arange(len(own)), np.full(len(own), copy_of)
            else:
                first = np.zeros(len(own), dtype=bool)
                first[np.unique(own, return_index=True)[1]] = True
                reference = np.full(len(own), here)
                repeated = ~first
                if found:
                    repeated[found] = True
                    reference[found] = known
                at = np.flatnonzero(repeated)
                references = reference[at]
            spans = factors(at, references)
            kept = np.ones(len(text), dtype=bool)
            for begin, end, _ in spans:
                kept[begin:end] = False
            left = text if kept.all() else compress(text, kept.tolist())
            yield (
                row[2],
                len(text),
                int(len(text) - kept.sum()),
                hashlib.sha256(b" ".join(left)).hexdigest(),
                ",".join(f"{begin}:{end}:{'' if ref == FIRST else ref}" for begin, end, ref in spans),
            )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, factors.

    Words stand between blanks. A word goes if a window of WINDOW words around it also starts earlier: in a document with a smaller id,
    or earlier in the same one; windows are judged on the texts as given. kept_sha256 is that of the words left, joined by
    a space. factors: first word, end and reference id of each, in order. A null text has no words; a null id is smaller than all others.
    Rows with one id are one document: if their texts are equal, the first read is the earlier one, else neither
    is. Other columns are not read. An empty table gives no rows.

    Passages that many texts share meet in partial aggregates; nothing is gathered by passage.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    base = docs.select(F.xxhash64(text).alias("mark"), text.alias("text"), F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("sha"))
    scan = Scan(base.select("mark", "text", "id"))
    id_or_first = F.coalesce("id", F.lit(FIRST))
    rows = stored(Scan(base).places("id", "sha"), "rows")
    originals = rows.groupBy("sha").agg(F.count("*").alias("n"), F.min(id_or_first).alias("copy_of"), F.min_by("row", id_or_first).alias("original"))
    originals = stored(originals.where("n > 1"), "originals")  # a shuffle of its own before the join, so that a text of many rows is split there
    copies = stored(
        rows.join(originals, "sha").where(F.col("row") != F.col("original")).select("row", "part", "place", "mark", "copy_of"), "copies"
    )
    sizes = partition_sizes(rows)

    packed = spark.createDataFrame(
        scan.attach(copies.select("part", "place", "mark", "copy_of"), sizes).mapPartitions(_seeds), "row long, seed binary", verifySchema=False
    )
    seed_rows = stored(packed.mapInArrow(_unpacked({"seed": "i8"}), "row long, seed long"), "seeds")
    shared = seed_rows.groupBy("seed").count().where("count > 1").select("seed")
    asked = seed_rows.join(shared, "seed").groupBy("row").agg(F.collect_list("seed").alias("seeds"))  # of one text, so bounded by it
    asked = rows.join(asked, "row").select("part", "place", "mark", "seeds")

    packed = spark.createDataFrame(
        scan.attach(asked, sizes).mapPartitions(_windows), "row long, id long, at binary, one binary, two binary", verifySchema=False
    )
    windows = stored(
        packed.mapInArrow(_unpacked({"at": "i4", "one": "i8", "two": "i8"}), "row long, id long, at int, one long, two long"), "windows"
    )
    index = windows.groupBy("one", "two").agg(F.min("id").alias("reference"), F.count("*").alias("n")).where("n > 1").drop("n")
    found = (
        windows.join(index, ["one", "two"])
        .where("reference < id")
        .groupBy("row")
        .agg(F.collect_list(F.struct("at", "reference")).alias("found"))
        .select("row", F.col("found.at").alias("at"), F.col("found.reference").alias("known"))
    )
    found = rows.join(found, "row").select("part", "place", "mark", F.lit(None).cast("long").alias("copy_of"), "at", "known")
    answers = found.unionByName(copies.drop("row"), allowMissingColumns=True)
    return spark.createDataFrame(
        scan.attach(stored(answers, "found"), sizes).mapPartitions(_removed),
        "doc_id long, n_words long, n_removed long, kept_sha256 string, factors string",
        verifySchema=False,
    )
