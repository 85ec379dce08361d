from __future__ import annotations

import hashlib

import numpy as np
import pytest

from clientlens.llm import delta_kmeans

COLUMNS = "vec_id long, embedding array<float>"


def plain(rows, clusters, rounds, dim, scale=64, seed=1):
    """The clustering with every distance worked out anew in Python integers."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    kept = [(i, v, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in kept]
    name = lambda i: (i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "")
    centroids = [x for _, _, x in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:clusters]]

    def assigned():
        found = []
        for i, _, x in kept:
            d, j = min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centroids))
            found.append((i, x, j, d))
        return found

    for _ in range(rounds):
        at = assigned()
        for j in range(len(centroids)):
            own = [x for _, x, k, _ in at if k == j]
            if own:
                centroids[j] = [sum(c) // len(own) for c in zip(*own)]
    at, spread = assigned(), {}
    for _, _, j, d in at:
        spread[j] = spread.get(j, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(map(str, ((i, j, d, spread[j], sum(spread.values()), digest[j]) for i, _, j, d in at)))


def found(df, **options):
    return sorted(str(tuple(r)) for r in delta_kmeans.cluster_vectors(df, **options).collect())


@pytest.mark.parametrize(("n", "clusters", "rounds"), [(300, 7, 3), (40, 16, 0), (5, 16, 3)])
def test_equals_plain_clustering(table, n, clusters, rounds):
    rng = np.random.default_rng(n)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(n)]
    assert found(table(COLUMNS, rows), clusters=clusters, rounds=rounds, dim=8) == plain(rows, clusters, rounds, 8)


def test_awkward_rows(table):
    """Nulls, other lengths, non-finite components, repeated rows and ids, a vector without id, ties, clashing names."""
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (1, [5.0, -1.0]), (2, [-5.0, -1.0]), (None, [3.0, 3.0]), (3, None), (4, []), (5, [1.0])]
    rows += [(6, [None, 1.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [0.0, 0.0]), (10, [2.0, 0.0]), (11, [1.0, 0.0]), (12, [1.0, 2.0, 3.0])]
    df = table(COLUMNS, rows, ("cluster", "was", "x", "id", "dots", "a.b"))
    for clusters in (1, 2, 4, 20):
        assert found(df, clusters=clusters, dim=2) == plain(rows, clusters, 3, 2)


def test_one_cluster_holds_nearly_all(table):
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 1.0, 1.0]) for i in range(500)] + [(i, [float(x) for x in rng.normal(size=3).astype(np.float32)]) for i in range(500, 520)]
    assert found(table(COLUMNS, rows), clusters=6, dim=3) == plain(rows, 6, 3, 3)


def test_empty_table(table, spark):
    assert found(spark.createDataFrame([], COLUMNS)) == []
    assert found(table(COLUMNS, [(1, None)])) == []


def test_products_change_by_changed_components_only():
    rng = np.random.default_rng(4)
    x, old = rng.integers(-99, 99, (50, 6)), rng.integers(-99, 99, (4, 6))
    new = old.copy()
    new[1, 2] += 5
    new[3] -= 1
    by = delta_kmeans.changes(old, new)
    assert [(j, at.tolist()) for j, at, _ in by] == [(1, [2]), (3, list(range(6)))]
    assert (delta_kmeans.moved(x, x @ old.T, by) == x @ new.T).all()


def test_too_large_components_are_an_error(table):
    with pytest.raises(Exception, match="no exact distance"):
        delta_kmeans.cluster_vectors(table(COLUMNS, [(1, [1e30, 0.0])]), dim=2)
