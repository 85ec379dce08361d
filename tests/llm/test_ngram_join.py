from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from clientlens.llm import ngram_join
from clientlens.llm.components import components

from awkward_rows import AWKWARD


def runs(text):
    words = (text or "").encode().lower().split()
    n = min(ngram_join.RUN, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else frozenset()


def plain(rows):
    """id, class and links of each row, by comparing all pairs."""
    sets = [runs(t) for _, t, *_ in rows]
    links = defaultdict(set)
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= ngram_join.SIMILARITY:
                links[a].add(b)
                links[b].add(a)
    out = []
    for a in range(len(rows)):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        ids = [rows[b][0] for b in seen if rows[b][0] is not None]
        out.append((rows[a][0], min(ids, default=None), len(links[a])))
    return sorted(map(str, out))


def check(rows, got):
    got = got.collect()
    assert sorted(str((r.doc_id, r.class_id, r.n_links)) for r in got) == plain(rows)
    return got


def edited(rng, n_groups, copies, words=60):
    rows = []
    for g in range(n_groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(words)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(words)] = f"e{rng.randrange(5000)}"
            rows.append((len(rows), " ".join(text)))
    return rows


def test_bands_reach_the_recall():
    b, r = ngram_join.bands()
    assert 1 - (1 - ngram_join.SIMILARITY**r) ** b >= ngram_join.RECALL and b * r <= ngram_join.HASHES


def test_near_copies(table):
    rows = edited(random.Random(1), 25, 6)
    got = check(rows, ngram_join.near_duplicates(table("doc_id long, text string", rows)))
    classes = defaultdict(list)
    for r in got:
        classes[r.class_id].append(r)
    for members in classes.values():
        assert [r.doc_id for r in members if r.kept] == [min(r.doc_id for r in members)]


def test_blocks_of_a_large_class(table, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rows = edited(random.Random(2), 1, 120)
    check(rows, ngram_join.near_duplicates(table("doc_id long, text string", rows)))


def test_common_runs():
    sets = [np.array(s, dtype=np.uint64) for s in ([1, 2, 3], [2, 3, 4], [9], [3])]
    assert ngram_join.common_runs(sets)[0].tolist()[1:] == [2, 0, 1]


def test_awkward_rows(awkward, empty):
    got = check(AWKWARD, ngram_join.near_duplicates(awkward))
    assert sum(r.kept for r in got) == len({(r.class_id, r.n_links) if r.n_links else (r.row, None) for r in got})
    assert ngram_join.near_duplicates(empty).collect() == []


@pytest.mark.parametrize("links", [[(1, 2), (2, 3), (5, 4)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)]])
def test_components(spark, links):
    label = {}
    for a, b in links:
        label.setdefault(a, a)
        label.setdefault(b, b)
    for _ in links:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == label


