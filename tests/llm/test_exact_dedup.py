from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from clientlens.llm.exact_dedup import find_duplicates, golomb_decode, golomb_encode

from awkward_rows import AWKWARD


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300))
def test_golomb_round_trip(values):
    sent = np.array(sorted(values), dtype=np.uint64)
    first, bits, coded = golomb_encode(sent)
    assert (golomb_decode(len(sent), first, bits, coded) == sent).all()


def test_golomb_is_near_the_entropy():
    sent = np.unique(np.random.default_rng(1).integers(0, 2**64, 50_000, dtype=np.uint64))
    assert len(golomb_encode(sent)[2]) * 8 / len(sent) < 64 - np.log2(len(sent)) + 2


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def check(rows, got):
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[lower(text)].append(i)
    want = sorted(
        (str(i), str(max((x for x in groups[lower(t)] if x is not None), default=None)), len(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest())
        for i, t, *_ in rows
    )
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in kept)


def test_awkward_rows(awkward):
    check(AWKWARD, find_duplicates(awkward).collect())


def test_few_owners_and_a_hot_group(table):
    rows = [(i, "same text" if i % 3 else f"text {i % 50}", "en", "s") for i in range(900)]
    check(rows, find_duplicates(table("doc_id long, text string, lang string, source string", rows), owners=3).collect())


def test_empty_table(empty):
    assert find_duplicates(empty).collect() == []
