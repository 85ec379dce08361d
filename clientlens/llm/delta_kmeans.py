"""Centroid clustering by an incrementally kept matrix of dot products.

Components are taken to whole numbers, so every figure is exact. Of each vector, the dot product with every centroid is stored beside it. When
centroids move, a product changes by the components that changed times the vector's: only these are multiplied, and the argmin over the
products is taken anew. The sums behind the centroids are kept in the same way: only vectors that went to another cluster are
taken from one sum and added to the other.

Every round writes the table to the shared folder once, in place of the one before. Only centroids go through the driver: their number and
dimension are parameters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import stored

DIM, CLUSTERS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, 1
ROWS = 4096  # vectors multiplied at once
NO_CLUSTER = -1


def largest(dim: int) -> int:
    """The bound on whole components: squared distances of `dim` of them stay within 62 bits."""
    return isqrt(2**62 // dim) // 2


def usable(vector: Column, dim: int) -> Column:
    """Vectors of the dimension without null and non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(vector) == dim) & F.forall(vector, finite), F.lit(False))


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers."""
    scaled = np.floor(scale * x)
    if np.abs(scaled).max(initial=0) > largest(x.shape[1]):
        raise ValueError(f"components beyond {largest(x.shape[1]) / scale:.0f} have no exact distance in 64 bits")
    return scaled.astype(np.int64)


def changes(old: np.ndarray, new: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Centroid, its changed components and by how much, of centroids that changed."""
    delta = new - old
    return [(j, at, delta[j, at]) for j in range(len(delta)) if len(at := np.flatnonzero(delta[j]))]


def moved(x: np.ndarray, dots: np.ndarray, by: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """The dot products after the centroids changed."""
    dots = dots.copy()
    for j, at, delta in by:
        dots[:, j] += x[:, at] @ delta
    return dots


def nearest(dots: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each vector, ties to the smaller number: the vector's own square is common to all."""
    return ((centroids**2).sum(axis=1)[None, :] - 2 * dots).argmin(axis=1)


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def listed(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), pa.int64()))


TABLE = "id long, x array<long>, dots array<long>, cluster int, was int"


def first_round(scale: int, dim: int, centroids: np.ndarray):
    """Whole components, all products and the first clusters of batches (id, vector)."""
    by = changes(np.zeros_like(centroids), centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, ROWS):
                batch = whole_batch.slice(at, ROWS)
                x = whole(matrix(batch.column(1), dim).astype(np.float64), scale)
                yield rows_of(batch.column(0), x, moved(x, np.zeros((len(x), len(centroids)), dtype=np.int64), by), None, centroids)

    return run


def next_round(dim: int, old: np.ndarray, new: np.ndarray):
    """The products after centroids changed, and the clusters that follow."""
    by = changes(old, new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, ROWS):
                batch = whole_batch.slice(at, ROWS)
                x = matrix(batch.column(1), dim)
                yield rows_of(batch.column(0), x, moved(x, matrix(batch.column(2), len(new)), by), batch.column(3), new)

    return run


def rows_of(ids: pa.Array, x: np.ndarray, dots: np.ndarray, was: pa.Array | None, centroids: np.ndarray) -> pa.RecordBatch:
    cluster = pa.array(nearest(dots, centroids), pa.int32())
    was = pa.array(np.full(len(x), NO_CLUSTER), pa.int32()) if was is None else was
    return pa.RecordBatch.from_arrays([ids, listed(x), listed(dots), cluster, was], names=["id", "x", "dots", "cluster", "was"])


@dataclass
class Clusters:
    """Exact sums and sizes of the clusters, and the centroids that follow from them."""

    centroids: np.ndarray
    sums: list[list[int]] = field(init=False)
    sizes: list[int] = field(init=False)

    def __post_init__(self) -> None:
        self.sums = [[0] * self.centroids.shape[1] for _ in self.centroids]
        self.sizes = [0] * len(self.centroids)

    def update(self, table: DataFrame) -> np.ndarray:
        """The centroids after this table's clusters; one row for each cluster comes to the driver."""
        dim = self.centroids.shape[1]
        joined = F.struct(F.col("cluster").alias("of"), F.lit(1).alias("sign"))
        left = F.struct(F.col("was").alias("of"), F.lit(-1).alias("sign"))
        went = table.where("cluster <> was").select("x", F.explode(F.array(joined, left)).alias("move")).select("x", "move.*")
        sums = [F.sum(F.col("sign") * F.col("x")[i]).alias(f"x{i}") for i in range(dim)]
        for row in went.where(f"of <> {NO_CLUSTER}").groupBy("of").agg(F.sum("sign").alias("n"), *sums).collect():
            self.sizes[row["of"]] += row["n"]
            self.sums[row["of"]] = [a + row[f"x{i}"] for i, a in enumerate(self.sums[row["of"]])]
        return np.array(
            [[s // n for s in sums] if n else old.tolist() for sums, n, old in zip(self.sums, self.sizes, self.centroids)], dtype=np.int64
        ).reshape(self.centroids.shape)


def cluster_vectors(
    embeddings: DataFrame,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    dim: int = DIM,
    scale: int = SCALE,
    seed: int = SEED,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of `dim` components, none of them null or non-finite; a component x becomes floor(scale * x). The first centroids are the
    kept vectors with the smallest SHA-256 of `seed:id`, in that order; vectors without id come last there, and of vectors with one id the smaller
    ones come first. If fewer vectors are kept than `clusters`, each is a centroid. A round gives every vector to its nearest centroid (ties: the smaller
    number) and puts each centroid that has vectors at their mean, rounded down; then vectors are given once more. Repeated rows count
    each. Other columns are not read. An empty table gives no rows. Components too large for exact 64-bit distances are an error.
    """
    spark = embeddings.sparkSession
    vector = F.col(vector_col).cast("array<double>")
    kept = embeddings.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector")).where(usable(F.col("vector"), dim))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    firsts = kept.orderBy(order.asc_nulls_last(), "vector").limit(clusters).collect()
    if not firsts:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = whole(np.array([r["vector"] for r in firsts], dtype=np.float64), scale)
    table = stored(kept.mapInArrow(first_round(scale, dim, centroids), TABLE), "clusters")
    state = Clusters(centroids)
    for _ in range(rounds):
        new = state.update(table)
        table = stored(table.mapInArrow(next_round(dim, state.centroids, new), TABLE), "clusters")
        state.centroids = new

    # |x|^2 - 2 x.c + |c|^2, with the squares of the centroids and their digests as one small row each.
    square = F.aggregate("x", F.lit(0).cast("long"), lambda a, x: a + x * x)
    digests = [
        (j, int((c**2).sum()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(state.centroids)
    ]
    known = spark.createDataFrame(digests, "cluster int, centre long, centroid_sha256 string")
    placed = table.join(F.broadcast(known), "cluster").select(
        F.col("id").alias("vec_id"),
        "cluster",
        (square - 2 * F.col("dots")[F.col("cluster")] + F.col("centre")).alias("distance"),
        "centroid_sha256",
    )
    placed = stored(placed, "distances")
    sums = {r["cluster"]: r["n"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}  # one for each centroid
    total = sum(sums.values())
    spread = spark.createDataFrame([(j, n, total) for j, n in sums.items()], "cluster int, cluster_inertia long, inertia long")
    return placed.join(F.broadcast(spread), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def cluster_sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> str:
    """The same over a view `embeddings` for DuckDB, with all distances worked out anew in every round."""
    finite = "x IS NOT NULL AND isfinite(x::DOUBLE)"
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), embedding) - 1 AS place,
          list_transform(embedding, lambda x: CAST(floor({scale} * x::DOUBLE) AS BIGINT)) AS x
          FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: {finite})) = {dim})""",
        f"c0 AS MATERIALIZED (SELECT place AS cluster, x AS c FROM kept WHERE place < {clusters})",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (SELECT place, any_value(vec_id) AS vec_id, any_value(x) AS x, min_by(cluster, (d, cluster)) AS cluster, min(d) AS d
            FROM (SELECT k.*, cluster, CAST(list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
              FROM kept k, c{r}) GROUP BY place)"""
        )
        if r < rounds:
            # Sums are whole numbers; // rounds towards zero, so negative ones take a step down where something is left over.
            mean = "CAST(s // n - CASE WHEN s < 0 AND s % n <> 0 THEN 1 ELSE 0 END AS BIGINT)"
            steps.append(
                f"""c{r + 1} AS MATERIALIZED (SELECT c{r}.cluster, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN
                (SELECT cluster, list({mean} ORDER BY i) AS c FROM
                  (SELECT cluster, i, sum(v) AS s, count(*) AS n FROM
                    (SELECT cluster, unnest(x) AS v, unnest(range(1, {dim} + 1)) AS i FROM a{r}) GROUP BY cluster, i) GROUP BY cluster) m
                ON m.cluster = c{r}.cluster)"""
            )
    return f"""WITH {", ".join(steps)}
      SELECT vec_id, CAST(a.cluster AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
        CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
      FROM a{rounds} a JOIN c{rounds} c ON a.cluster = c.cluster"""
