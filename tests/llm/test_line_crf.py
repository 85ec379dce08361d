from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import functions as F

from clientlens.llm import line_crf

SAMPLE = "/root/testdata/sf0.01"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    counts = np.array([3, 1, 5, 2])
    emit, steps = rng.normal(size=counts.sum()), rng.normal(size=(2, 2))
    good, pairs = line_crf.marginals(emit, counts, steps)
    want, want_pairs, at = [], np.zeros((2, 2)), 0
    for n in counts:
        total, own, own_pairs = 0.0, np.zeros(n), np.zeros((2, 2))
        for labels in product((0, 1), repeat=int(n)):
            weight = np.exp(sum(emit[at + t] * y for t, y in enumerate(labels)) + sum(steps[a, b] for a, b in zip(labels, labels[1:])))
            total += weight
            own += weight * np.array(labels)
            for a, b in zip(labels, labels[1:]):
                own_pairs[a, b] += weight
        want += list(own / total)
        want_pairs += own_pairs / total
        at += n
    assert np.allclose(good, want) and np.allclose(pairs, want_pairs)


def test_neighbours_stay_in_their_text():
    x = np.arange(1.0, 6.0)[:, None]
    near = line_crf.with_neighbours(x, np.array([2, 3]))
    assert near.tolist() == [[1, 0, 2], [2, 1, 0], [3, 0, 4], [4, 3, 5], [5, 4, 0]]


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SAMPLE}/{t}.parquet") for t in ("documents", "labels"))
    model = line_crf.learn(docs, labels)
    rows = line_crf.score_quality(docs.join(labels, "doc_id"), model).where(line_crf.held_out()).select("quality", "score").collect()
    assert np.mean([(r.score >= line_crf.THRESHOLD) == r.quality for r in rows]) > 0.95
    bad, good = ([r.score for r in rows if r.quality == q] for q in (0, 1))
    assert np.mean([b < g for b in bad for g in good]) > 0.97


def test_scores_do_not_depend_on_neighbouring_rows(spark):
    docs, labels = (spark.read.parquet(f"{SAMPLE}/{t}.parquet") for t in ("documents", "labels"))
    model = line_crf.learn(docs, labels, sample=200)
    one = {r.doc_id: r.score for r in line_crf.score_quality(docs, model).select("doc_id", "score").collect()}
    two = {r.doc_id: r.score for r in line_crf.score_quality(docs.repartition(7), model).select("doc_id", "score").collect()}
    assert all(abs(one[i] - two[i]) < 1e-9 for i in one)


def test_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1), (2, 1), (2, 0), (5, 0), (9, 0), (None, 1), (7, None), (99, 1)], "doc_id long, quality int")
    model = line_crf.learn(awkward, labels)
    rows = line_crf.score_quality(awkward.select("doc_id", "text"), model).collect()
    assert len(rows) == 14 and all(0 <= r.score <= 1 for r in rows)
    nothing = line_crf.learn(awkward, labels.where("false"))
    assert {r.score for r in line_crf.score_quality(awkward.select("doc_id", "text"), nothing).collect()} == {0.5}
    assert line_crf.score_quality(empty, line_crf.learn(empty, labels)).collect() == []


def test_held_out_labels_are_not_read(spark):
    docs, labels = (spark.read.parquet(f"{SAMPLE}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(line_crf.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = line_crf.learn(docs, labels, sample=300), line_crf.learn(docs, turned, sample=300)
    assert np.allclose(one.weights, two.weights)
