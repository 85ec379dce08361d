"""Nearest neighbours by cross-polytope hashing.

A table turns every vector by a fast pseudo-rotation (random signs and a Hadamard transform, three times) and files it under the signed
axis it then lies nearest to. A query looks under its nearest axes in each table, and all vectors found there are ranked by
their exact inner product.

Vectors are told apart by length, in ranges of a quarter octave. They get one more coordinate that makes all of a range as long as its
longest, and queries a zero there: within a range the largest inner product is then the smallest angle. A query has the same
axes for all ranges, so their vectors share buckets, and a few long vectors do not draw the others together.

How many axes a query looks under follows from the dimension and a target recall. A query that finds too few there is compared with
all vectors.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import stored

TABLES = 8
RECALL = 0.98  # aimed at for random directions, which are the farthest apart
LEAST_PROBES = 28 / 256  # of the signed axes
BLOCK = 4096  # vectors compared at once; a larger bucket is split
RANGES = 4  # of lengths in an octave
AT_ONCE = 256  # queries compared at once
SEED = 20


def padded(dim: int) -> int:
    """The next power of two that has room for one more coordinate."""
    return 1 << dim.bit_length()


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of each row, in n log n steps."""
    n, size = x.shape[1], 1
    while size < n:
        pairs = x.reshape(len(x), n // (2 * size), 2, size)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
        size *= 2
    return x / np.sqrt(n)


def signs(table: int, size: int) -> np.ndarray:
    """The three rows of random signs of a table's rotation."""
    return np.random.default_rng([SEED, table]).choice(np.array([-1.0, 1.0]), (3, size))


def axes(x: np.ndarray, table: int, probes: int) -> np.ndarray:
    """The nearest signed axes of each row, nearest first: the axis, plus the dimension if it is negative."""
    for s in signs(table, x.shape[1]):
        x = hadamard(x * s)
    if probes == 1:
        x = np.concatenate([x, -x], axis=1)
        return x.argmax(axis=1)[:, None]
    return np.argsort(np.concatenate([-x, x], axis=1), axis=1, kind="stable")[:, :probes]


def probes_for(dim: int, n: int, k: int, tables: int, recall: float = RECALL) -> int:
    """Signed axes to look under in each table, so that the k-th nearest of n random directions is met with probability `recall`.

    Its cosine s is a quantile of the normal distribution, less by what a range of lengths leaves open. On the axis a vector is
    filed under it has the largest of `size` normal values, m, and a query has one around s * m.
    """
    normal, size = NormalDist(), padded(dim)
    s = max(0.0, normal.inv_cdf(1 - min(0.5, k / max(1, n)))) / dim**0.5 / 2 ** (1 / RANGES)
    s = min(s, 0.99)
    m = normal.inv_cdf((1 + 0.5 ** (1 / size)) / 2)
    met = 1 - (1 - recall) ** (1 / tables)
    share = 1 - normal.cdf(s * m + (1 - s * s) ** 0.5 * normal.inv_cdf(1 - met))
    return math.ceil(2 * size * max(share, LEAST_PROBES))


def matrix(vectors: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1).astype(np.float64)


def lifted(x: np.ndarray, longest: np.ndarray | None) -> np.ndarray:
    """Unit vectors with the additional coordinate, padded by zeros; `longest`: of each one's range, or None for queries."""
    out = np.zeros((len(x), padded(x.shape[1])))
    if longest is None:
        x = x / np.abs(x).max(axis=1, keepdims=True)
        out[:, : x.shape[1]] = x / np.linalg.norm(x, axis=1, keepdims=True)
    else:
        out[:, : x.shape[1]] = x / longest[:, None]
        out[:, x.shape[1]] = np.sqrt(np.maximum(0.0, 1.0 - (out**2).sum(axis=1)))
    return out


def usable(vector: Column, dim: int) -> Column:
    """Vectors of the common length that are not zero and hold finite numbers only."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(vector) == dim) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def length(vector: Column) -> Column:
    """Of a usable vector; scaled, so that squares neither vanish nor overflow."""
    most = F.array_max(F.transform(vector, F.abs))
    return F.least(most * F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + (x / most) * (x / most))), F.lit(sys.float_info.max))


def filed(vectors: DataFrame, longest: dict[int, float] | None, probes: int, tables: int) -> DataFrame:
    """`probes` rows for each vector and table: tab, axis, id, vector.

    `vectors`: id, vector and range. `longest`: the longest of each range, or None for queries.
    """

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = lifted(matrix(batch.column(1)), None if longest is None else np.array([longest[r] for r in batch.column(2).to_pylist()]))
            for table in range(tables):
                found = axes(x, table, probes)
                rows = pa.array(np.repeat(np.arange(len(x)), found.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(found.size, table), pa.int32()),
                        pa.array(found.ravel(), pa.int32()),
                        batch.column(0).take(rows),
                        batch.column(1).take(rows),
                    ],
                    names=["tab", "axis", "id", "vector"],
                )

    return vectors.mapInArrow(file, "tab int, axis int, id long, vector array<double>")


def nearest(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Query, id and score of the k nearest to each query, nearest first, ties to the smaller id; of one id the nearest counts.

    Scores are sums over the coordinates in their order, so they do not depend on what else is compared.
    """
    most = k + len(ids) - len(np.unique(ids))
    for at in range(0, len(q), AT_ONCE):
        own_ids, own = q_ids[at : at + AT_ONCE], q[at : at + AT_ONCE]
        rough = own @ x.T
        rough[own_ids[:, None] == ids[None, :]] = -np.inf
        least = np.partition(rough, len(ids) - most, axis=1)[:, len(ids) - most] if len(ids) > most else np.full(len(own), -np.inf)
        rows, cols = np.nonzero((rough >= (least - 1e-9 * (1 + np.abs(least)))[:, None]) & (rough > -np.inf))
        score = np.zeros(len(rows))
        for j in range(x.shape[1]):
            score += own[rows, j] * x[cols, j]
        if most > k:
            order = np.lexsort((-score, ids[cols], rows))
            rows, cols, score = rows[order], cols[order], score[order]
            again = np.append([False], (rows[1:] == rows[:-1]) & (ids[cols[1:]] == ids[cols[:-1]]))[: len(rows)]
            rows, cols, score = rows[~again], cols[~again], score[~again]
        order = np.lexsort((ids[cols], -score, rows))
        rows, cols, score = rows[order], cols[order], score[order]
        first = np.searchsorted(rows, rows)
        kept = np.arange(len(rows)) - first < k
        yield own_ids[rows[kept]], ids[cols[kept]], score[kept]


def search(embeddings: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, probes: int | None = None) -> DataFrame:
    """The k nearest that were found for each query row: query_id, rank, vec_id, score.

    `queries` tells which rows are queries; every other row is a candidate for each of them. Nearness is the inner product
    of the given vectors in double precision, ties go to the smaller id. Rows without id take no part, nor do vectors that
    are null, zero, hold null or infinite components, or have another length than most. Of rows with one id, the nearer counts. A query
    has all candidates if they are fewer than k, else k. Other columns are not read. An empty table gives no rows.

    Every vector is filed in each table. A bucket of more than BLOCK vectors is split, and queries go to all its parts.
    Queries that find fewer than k, or than there are, are compared with all vectors in blocks. `probes`: axes that a query looks
    under in each table, by default those of `probes_for`; twice the padded dimension makes the search exact.
    """
    vector = F.col(vector_col).cast("array<double>")
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"), queries.alias("is_query")).where("id is not null")
    common = rows.where("size(vector) > 0").groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if common is None:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(usable(F.col("vector"), common.dim))
    ranged = rows.withColumn("length", length(F.col("vector"))).withColumn("range", F.round(F.log2("length") * RANGES).cast("int"))
    # Exponents of doubles bound the number of ranges.
    longest = {r.range: r.longest for r in ranged.groupBy("range").agg(F.max("length").alias("longest")).collect()}
    n, n_ids = rows.agg(F.count("*"), F.countDistinct("id")).first()
    if probes is None:
        probes = probes_for(common.dim, n, k, tables)

    filed_rows = filed(ranged.select("id", "vector", "range"), longest, 1, tables)
    asked = filed(rows.where("is_query").select("id", "vector", F.lit(0).alias("range")), None, probes, tables)
    # One row for each table and axis: a bounded number.
    parts = F.broadcast(filed_rows.groupBy("tab", "axis").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")))
    blocks = filed_rows.join(parts, ["tab", "axis"]).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).drop("parts")
    asked = asked.join(parts, ["tab", "axis"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def compare(block: pa.Table, wanted: pa.Table) -> pa.Table:
        found = []
        if block.num_rows and wanted.num_rows:
            q, x = matrix(wanted["vector"]), matrix(block["vector"])
            for of, ids, score in nearest(wanted["id"].to_numpy(), q, block["id"].to_numpy(), x, k):
                starts = np.flatnonzero(np.append([True], of[1:] != of[:-1])) if len(of) else np.empty(0, int)
                offsets = pa.array(np.append(starts, len(of)), pa.int32())
                found.append(
                    pa.table(
                        {
                            "query_id": pa.array(of[starts], pa.int64()),
                            "ids": pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int64())),
                            "scores": pa.ListArray.from_arrays(offsets, pa.array(score, pa.float64())),
                        }
                    )
                )
        empty = pa.schema([("query_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])
        return pa.concat_tables(found).cast(empty) if found else empty.empty_table()

    def merge(lists: pa.Table) -> pa.Table:
        ids = lists["ids"].combine_chunks().flatten().to_numpy()
        score = lists["scores"].combine_chunks().flatten().to_numpy()
        order = np.lexsort((-score, ids))
        ids, score = ids[order], score[order]
        once = np.append([True], ids[1:] != ids[:-1]) if len(ids) else np.empty(0, bool)
        ids, score = ids[once], score[once]
        order = np.lexsort((ids, -score))[:k]
        n = len(order)
        return pa.table(
            {
                "query_id": pa.array(np.full(n, lists["query_id"][0].as_py()), pa.int64()),
                "rank": pa.array(np.arange(1, n + 1), pa.int32()),
                "vec_id": pa.array(ids[order], pa.int64()),
                "score": pa.array(score[order], pa.float64()),
            }
        )

    lists = "query_id long, ids array<long>, scores array<double>"
    result = "query_id long, rank int, vec_id long, score double"
    near = stored(
        blocks.groupBy("tab", "axis", "part")
        .cogroup(asked.groupBy("tab", "axis", "part"))
        .applyInArrow(compare, lists)
        .groupBy("query_id")
        .applyInArrow(merge, result),
        "near",
    )
    whole = near.groupBy("query_id").count().where(F.col("count") >= min(k, n_ids - 1)).select("query_id")
    short = stored(rows.where("is_query").join(whole, F.col("id") == F.col("query_id"), "left_anti").select("id", "vector"), "short")
    n_short = short.count()
    if not n_short or n_ids < 2:
        return near
    # All vectors against all short queries: each block of the ones meets each of the others.
    n_parts, n_asking = -(-n // BLOCK), -(-n_short // BLOCK)
    part = lambda of: F.pmod(F.xxhash64("id"), F.lit(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    blocks = rows.select("id", "vector", part(n_parts).alias("part"), each(n_asking).alias("asking"))
    asked = short.select("id", "vector", part(n_asking).alias("asking"), each(n_parts).alias("part"))
    rest = blocks.groupBy("part", "asking").cogroup(asked.groupBy("part", "asking")).applyInArrow(compare, lists)
    return near.join(whole, "query_id", "left_semi").unionByName(rest.groupBy("query_id").applyInArrow(merge, result))
