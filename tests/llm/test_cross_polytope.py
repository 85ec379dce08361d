from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from clientlens.llm import cross_polytope as cp

SAMPLE = "/root/testdata"


def exact(rows, is_query, k):
    """All candidates of each query, nearest first."""
    vectors = {i: np.array(v, dtype=np.float64) for i, v in rows}
    out = {}
    for q in filter(is_query, vectors):
        near = sorted((-float(vectors[q] @ v), i) for i, v in vectors.items() if i != q)
        out[q] = [(i, -s) for s, i in near[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_hadamard():
    h = cp.hadamard(np.eye(8))
    assert np.allclose(h @ h.T, np.eye(8)) and np.allclose(np.abs(h), 8**-0.5)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall(spark, sf):
    table = spark.read.parquet(f"{SAMPLE}/{sf}/embeddings.parquet")
    want = exact([(r.vec_id, r.embedding) for r in table.collect()], lambda i: i % 20 == 0, 20)
    got = found(cp.search(table, F.col("vec_id") % 20 == 0))
    assert got.keys() == want.keys()
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    vectors = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in table.collect()}
    for q, near in got.items():
        assert near == sorted(near, key=lambda x: (-x[1], x[0]))
        assert all(abs(float(vectors[q] @ vectors[i]) - s) < 1e-12 for i, s in near)


def test_all_probes_are_exact_and_lengths_count(table):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6) * rng.uniform(0.1, 5)]) for i in range(60)]
    got = found(cp.search(table("vec_id long, embedding array<float>", rows, ("score", "rank")), F.col("vec_id") < 5, k=7, probes=16))
    rows = [(i, np.float32(v).tolist()) for i, v in rows]
    want = exact(rows, lambda i: i < 5, 7)
    assert {q: [i for i, _ in near] for q, near in got.items()} == {q: [i for i, _ in near] for q, near in want.items()}


def test_ties_and_split_buckets(table, monkeypatch):
    monkeypatch.setattr(cp, "BLOCK", 8)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(100)]
    got = found(cp.search(table("vec_id long, embedding array<double>", rows), F.col("vec_id") == 50, k=5))
    assert got == {50: [(i, 14.0) for i in range(5)]}


def test_unusable_vectors(spark, table):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (8, [1.0, 1.0, 1.0]), (None, [1.0, 1.0]), (20, [2.0, 1.0])]
    got = found(cp.search(table("vec_id long, embedding array<double>", rows), F.col("vec_id") % 20 == 0))
    assert {q: [i for i, _ in near] for q, near in got.items()} == {0: [20, 1], 20: [0, 1]}
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert cp.search(empty, F.col("vec_id") % 20 == 0).collect() == []
    nothing = spark.createDataFrame([(1, [0.0]), (2, None)], "vec_id long, embedding array<float>")
    assert cp.search(nothing, F.lit(True)).collect() == []


@pytest.mark.parametrize("lengths", ["lognormal", "outlier"])
def test_recall_with_mixed_lengths(table, lengths):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if lengths == "lognormal":
        x *= rng.lognormal(0, 0.5, (len(x), 1))
    x[1] *= 100
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    want = exact(rows, lambda i: i % 20 == 0, 20)
    got = found(cp.search(table("vec_id long, embedding array<double>", rows), F.col("vec_id") % 20 == 0))
    recall = np.mean([len({i for i, _ in got.get(q, [])} & {i for i, _ in want[q]}) / 20 for q in want])
    print("recall", lengths, recall)
    assert recall >= 0.9


def test_lengths_beyond_their_squares(table):
    rows = [(0, [1e200, 1e200]), (1, [1e-200, 0.0]), (2, [0.0, 1e-200]), (3, [1.0, 2.0])]
    got = found(cp.search(table("vec_id long, embedding array<double>", rows), F.col("vec_id") == 0, probes=8))
    assert [i for i, _ in got[0]] == [3, 1, 2]


@pytest.mark.parametrize("n", [8, 15, 21])
def test_few_vectors_are_all_found(table, n):
    x = np.random.default_rng(n).normal(size=(n, 64))
    rows = [(i, v) for i, v in enumerate((x / np.linalg.norm(x, axis=1, keepdims=True)).tolist())]
    got = found(cp.search(table("vec_id long, embedding array<double>", rows), F.lit(True)))
    want = exact(rows, lambda i: True, 20)
    assert {q: [i for i, _ in near] for q, near in got.items()} == {q: [i for i, _ in near] for q, near in want.items()}


def test_queries_that_find_too_few_meet_all(table, monkeypatch):
    monkeypatch.setattr(cp, "BLOCK", 16)  # several blocks of both
    x = np.random.default_rng(3).normal(size=(60, 64))
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    got = found(cp.search(table("vec_id long, embedding array<double>", rows), F.col("vec_id") < 40, tables=1, probes=1))
    want = exact(rows, lambda i: i < 40, 20)
    assert {q: [i for i, _ in near] for q, near in got.items()} == {q: [i for i, _ in near] for q, near in want.items()}


def test_many_rows_of_one_id_leave_room_for_others(table):
    rows = [(0, [1.0, 0.0])] + [(1, [5.0, 0.1])] * 30 + [(i, [1.0, 0.1]) for i in range(2, 9)]
    got = found(cp.search(table("vec_id long, embedding array<double>", rows), F.col("vec_id") == 0, k=5))
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5]


def test_probes_follow_the_dimension():
    assert [cp.probes_for(d, 5000, 20, 8) / (2 * cp.padded(d)) > cp.LEAST_PROBES for d in (64, 256, 768)] == [True] * 3
    rng = np.random.default_rng(5)
    for size in (128, 512):  # every signed axis is among as many probes
        assert sorted(cp.axes(rng.normal(size=(1, size)), 0, 2 * size)[0].tolist()) == list(range(2 * size))


def test_recall_in_many_dimensions(table):
    x = np.random.default_rng(6).normal(size=(1500, 256))
    rows = [(i, v) for i, v in enumerate((x / np.linalg.norm(x, axis=1, keepdims=True)).tolist())]
    want = exact(rows, lambda i: i % 100 == 0, 20)
    got = found(cp.search(table("vec_id long, embedding array<double>", rows), F.col("vec_id") % 100 == 0))
    recall = np.mean([len({i for i, _ in got.get(q, [])} & {i for i, _ in want[q]}) / 20 for q in want])
    print("recall256", recall)
    assert recall >= 0.95
