"""Near duplicates by MinHash banding.

A text is the set of its five-word runs. Texts with one set are copies and stand for each other. Bands of MinHash values bring sets together
that are probably alike: the number of bands and of values in each follows from the similarity and the recall that are asked for. Every pair of
sets that meets in a band is then verified on the whole sets.

Pairs are compared inside blocks of sets that met, each pair where it met first. What leaves a block is the number of links of each set and
enough of the links to tell what hangs together, so the rows in flight follow the number of texts and not that of pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from math import ceil, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .rows import Scan, partition_sizes, stored
from .texts import in_small_batches, valid
from .words import Hasher, batched, grams, mixed

RUN = 5  # words
SIMILARITY = 0.8
RECALL = 0.99999  # of pairs that are just similar enough
HASHES = 240  # MinHash values of a set, at most
BLOCK = 512  # sets compared at once; where more meet, blocks are compared with blocks
AT_ONCE = 2048  # runs hashed or compared at once


def bands(similarity: float = SIMILARITY, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """Bands and values in each: as many values as can be, so that few unlike pairs meet.

    A pair of similarity s meets with probability 1 - (1 - s**r)**b.
    """
    fits = []
    for values in range(1, hashes + 1):
        needed = ceil(log(1 - recall) / log1p(-(similarity**values))) if similarity < 1 else 1
        if needed * values <= hashes:
            fits.append((needed, values))
    if not fits:
        raise ValueError("so few hashes cannot reach this recall")
    return max(fits, key=lambda x: x[1])


def runs(words: np.ndarray) -> np.ndarray:
    """The sorted set of five-word runs; all words together, if there are fewer; nothing without words."""
    if not len(words):
        return np.empty(0, dtype=np.uint64)
    return np.unique(grams(words, min(RUN, len(words)), seed=1 if len(words) < RUN else 0))


def sets(texts: list[str | None], hasher: Hasher) -> list[np.ndarray]:
    """The sets of some texts, with A-Z in lower case."""
    words, counts = hasher.texts([(t or "").encode().lower() for t in texts])
    return [runs(own) for own in np.split(words, np.cumsum(counts)[:-1])]


def banded(own: np.ndarray, n_bands: int, values: int, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """A hash of each band of a set's MinHash values."""
    x = (own >> np.uint64(32)).astype(np.uint32)
    least = np.full(n_bands * values, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), AT_ONCE):
        np.minimum(least, (x[at : at + AT_ONCE, None] * factors + shifts).min(axis=0), out=least)
    rows = mixed(least.astype(np.uint64) + np.arange(n_bands * values, dtype=np.uint64) * np.uint64(2**32)).reshape(n_bands, values)
    return mixed(rows.sum(axis=1, dtype=np.uint64)).view(np.int64)


def _sketcher(n_bands: int, values: int):
    """row, part, place, mark, id, set (a digest), n (its size) and its bands; the latter once for each set in a partition."""
    rng = np.random.default_rng(6)
    factors = rng.integers(0, 2**32, n_bands * values, dtype=np.uint32) | np.uint32(1)
    shifts = rng.integers(0, 2**32, n_bands * values, dtype=np.uint32)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = Hasher(), set()
        for batch in batches:
            digests, sizes, found = [], [], []
            for texts in batched((t.as_py() for t in batch.column(5)), lambda t: len(t or "")):
                for own in sets(texts, hasher):
                    digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                    digests.append(digest)
                    sizes.append(len(own))
                    fresh = len(own) and digest not in seen
                    found.append(banded(own, n_bands, values, factors, shifts) if fresh else None)
                    if fresh:
                        seen.add(digest)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                names=["row", "part", "place", "mark", "id", "set", "n", "bands"],
            )

    return sketch


def _whole(pairs: Iterable) -> Iterator[tuple]:
    """node and its runs, of rows that were asked for them."""
    hasher = Hasher()
    for batch in batched((p for p in pairs if p[1] is not None), lambda p: len(p[0][1] or "")):
        for (_, answer), own in zip(batch, sets([row[1] for row, _ in batch], hasher)):
            yield answer[0], bytearray(own.tobytes())


def common_runs(own: list[np.ndarray]) -> np.ndarray:
    """How many runs any two of the sets have in common."""
    of = np.repeat(np.arange(len(own)), [len(x) for x in own])
    runs_of, count = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)[1:]
    shared = count > 1  # a run of one set alone is common to no two
    column = np.cumsum(shared) - 1
    inside = shared[runs_of]
    of, runs_of = of[inside], column[runs_of[inside]]
    order = np.argsort(runs_of, kind="stable")
    of, runs_of = of[order], runs_of[order]
    out = np.zeros((len(own), len(own)), dtype=np.float64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, AT_ONCE):
        lo, hi = np.searchsorted(runs_of, [at, at + AT_ONCE])
        has = np.zeros((len(own), AT_ONCE), dtype=np.float32)
        has[of[lo:hi], runs_of[lo:hi] - at] = 1
        out += has @ has.T
    return out


def verified(band: int, first: np.ndarray, banded_as: np.ndarray, own: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which pairs are similar, of those that met first in this band.

    `first`: which sets are of the first block; only pairs of both blocks are told, or all if there is one block.
    """
    met = np.ones((len(own), len(own)), dtype=bool)
    for k in range(band):
        met &= banded_as[:, None, k] != banded_as[None, :, k]
    met &= banded_as[:, None, band] == banded_as[None, :, band]
    if not first.all():
        met &= first[:, None] != first[None, :]
    np.fill_diagonal(met, False)
    common, size = common_runs(own), np.array([len(x) for x in own], dtype=np.float64)
    return met & (common >= similarity * (size[:, None] + size[None, :] - common) - 1e-9)


def roots(links: np.ndarray) -> np.ndarray:
    """For each set, the first one that it is linked with, directly or not."""
    label = np.arange(len(links))
    while True:
        near = np.where(links, label[None, :], len(links)).min(axis=1)
        lower = np.minimum(label, near)
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def _comparer(similarity: float):
    """Of sorted blocks: node, how many documents it is linked with there, and a node that it hangs together with."""

    def compare(rows: list[dict]) -> list[tuple]:
        own = [np.frombuffer(r["runs"], dtype=np.uint64) for r in rows]
        first = np.array([r["at"] == r["i"] for r in rows])
        links = verified(rows[0]["band"], first, np.array([r["bands"] for r in rows]), own, similarity)
        weights = np.array([r["n_copies"] for r in rows])
        root = roots(links)
        return [(rows[k]["node"], int(weights[links[k]].sum()), rows[root[k]]["node"]) for k in np.flatnonzero(links.any(axis=1))]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[dict] = []
        for batch in batches:
            found = []
            rows = (row for at in range(0, batch.num_rows, 64) for row in batch.slice(at, 64).to_pylist())
            for row in rows:
                if block and any(row[c] != block[0][c] for c in ("band", "slot", "i", "j")):
                    found += compare(block)
                    block = []
                block.append(row)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["node", "linked", "root"])
        if block and (found := compare(block)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["node", "linked", "root"])

    return blocks


def linked_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows, distinct sets, and their links as they leave the blocks.

    Rows: row, part, place, mark, id, set (a digest), n (its size). Sets: set, node (the first of its rows), n_copies. Links: node, linked (how many
    documents), root (a node of the same class).
    """
    docs = in_small_batches(docs)
    n_bands, values = bands(similarity, recall)
    scan = Scan(docs.select(F.xxhash64(text_col).alias("mark"), valid(F.col(text_col)).alias("text"), F.col(id_col).cast("long").alias("id")))
    rows = stored(
        scan.places("id", "text").mapInArrow(
            _sketcher(n_bands, values), "row long, part int, place long, mark long, id long, set binary, n long, bands array<long>"
        ),
        "sketches",
    )
    nodes = stored(
        rows.where("n > 0").groupBy("set").agg(F.min("row").alias("node"), F.count("*").alias("n_copies"), F.first("bands", True).alias("bands")), "nodes"
    )
    slots = nodes.select("node", F.posexplode("bands").alias("band", "slot"))
    # Where several sets meet; of slots that hold the same sets, the one of the first band.
    meetings = (
        slots.groupBy("band", "slot")
        .agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("one"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("two"))
        .where("size > 1")
        .groupBy("size", "one", "two")
        .agg(F.min_by("slot", "band").alias("slot"), F.min("band").alias("band"))
        .select("band", "slot", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    )
    members = stored(slots.join(stored(meetings, "meetings"), ["band", "slot"]), "members")

    asked = members.select("node").distinct()
    asked = rows.join(asked, rows["row"] == asked["node"], "left_semi").select("part", "place", "mark", F.col("row").alias("node"))
    sizes = partition_sizes(rows)
    whole = docs.sparkSession.createDataFrame(scan.attach(asked, sizes).mapPartitions(_whole), "node long, runs binary")
    whole = stored(whole.join(nodes.select("node", "n_copies", "bands"), "node"), "sets")

    at = F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks")).cast("int")
    placed = members.select("node", "band", "slot", at.alias("at"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = placed.select("node", "band", "slot", "at", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"))
    block = ["band", "slot", "i", "j"]
    links = placed.join(whole, "node").repartition(*block).sortWithinPartitions(*block, "node").mapInArrow(_comparer(similarity), "node long, linked long, root long")
    return rows.drop("bands"), nodes.drop("bands"), stored(links, "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, n_copies, kept, and its row, part, place and mark.

    class_id: the smallest id among all documents linked with it, directly or not. n_links: how many other documents
    are similar enough to it, copies included. n_copies: how many have the same set. kept: one document of each class, the one with the smallest
    id. A text without words (null counts as one) is alone. Malformed UTF-8 is read with replacement characters. Null ids come last; of rows with one id, one is kept. Other columns are
    not read. An empty table gives no rows.
    """
    rows, nodes, links = linked_sets(docs, id_col, text_col, similarity, recall)
    linked = links.groupBy("node").agg(F.sum("linked").alias("linked"))
    classes = components(links.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    sets_of = (
        nodes.join(linked, "node", "left")
        .join(classes, "node", "left")
        .select("set", "n_copies", F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("component", "node").alias("component"))
    )
    placed = stored(
        rows.join(sets_of, "set", "left").select(
            F.col("id").alias("doc_id"),
            F.coalesce("component", "row").alias("component"),
            F.coalesce(F.col("n_copies") - 1 + F.col("linked"), F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
            "row",
            "part",
            "place",
            "mark",
        ),
        "placed",
    )
    first = placed.groupBy("component").agg(
        F.min("doc_id").alias("class_id"), F.coalesce(F.min_by("row", "doc_id"), F.min("row")).alias("kept_row")
    )
    return placed.join(stored(first, "classes"), "component").select(
        "doc_id", "class_id", "n_links", "n_copies", (F.col("row") == F.col("kept_row")).alias("kept"), "row", "part", "place", "mark"
    )
