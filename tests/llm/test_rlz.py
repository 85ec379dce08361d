from __future__ import annotations

import hashlib
import random

import numpy as np

from clientlens.llm import rlz
from clientlens.llm.words import Hasher, grams

from awkward_rows import AWKWARD


def plain(rows):
    """By looking every window up among all that come before; rows of one id are one document."""
    first, copies = {}, {}
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    words = [(t or "").encode().split() for _, t, *_ in rows]
    for k in order:
        i, w = rows[k][0], words[k]
        for at in range(len(w) - rlz.WINDOW + 1):
            first.setdefault(tuple(w[at : at + rlz.WINDOW]), (i, k, at))
    out = []
    for k in order:
        i, w = rows[k][0], words[k]
        copy = copies.setdefault((i, rows[k][1]), k) != k
        kept = [True] * len(w)
        seen = set()
        for at in range(len(w) - rlz.WINDOW + 1):
            window = tuple(w[at : at + rlz.WINDOW])
            if copy or window in seen or first[window][0] != i:
                kept[at : at + rlz.WINDOW] = [False] * rlz.WINDOW
            seen.add(window)
        out.append((i, len(w), len(w) - sum(kept), hashlib.sha256(b" ".join(x for x, y in zip(w, kept) if y)).hexdigest()))
    return sorted(map(str, out))


def check(rows, got):
    assert sorted(str((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)) for r in got.collect()) == plain(rows)


def test_shared_passages(table):
    rng = random.Random(1)
    passages = [[f"p{p}x{k}" for k in range(rng.randint(15, 40))] for p in range(5)]
    rows = []
    for i in range(80):
        text = [f"w{rng.randrange(2000)}" for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randrange(3)):
            at = rng.randint(0, len(text))
            text[at:at] = rng.choice(passages)
        rows.append((100 - i, " \t".join(text)))
    rows += [(200, rows[3][1]), (201, rows[3][1])]
    check(rows, rlz.remove_repeats(table("doc_id long, text string", rows)))


def test_repeats_in_one_text(table):
    passage = " ".join(f"a{k}" for k in range(25))
    rows = [(1, f"{passage} x {passage} y z {passage}"), (2, "go " * 50), (3, "go " * 19)]
    check(rows, rlz.remove_repeats(table("doc_id long, text string", rows)))


def test_factors_end_where_the_reference_changes(table):
    a, b = ([f"{c}{k}" for k in range(30)] for c in "ab")
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(["new", *a, *b, "end"]))]
    got = {r.doc_id: r.factors for r in rlz.remove_repeats(table("doc_id long, text string", rows)).collect()}
    assert got == {1: "", 2: "", 3: "1:31:1,31:61:2"}


def test_least():
    x = np.random.default_rng(1).integers(0, 1000, 60)
    for n in range(1, 20):
        assert rlz.least(x, n).tolist() == [min(x[i : i + n]) for i in range(61 - n)]


def test_word_hashes_do_not_depend_on_place():
    h = Hasher()
    words, counts = h.texts([b"one  two\nthree", b"", b" two one\t"])
    assert counts.tolist() == [3, 0, 2]
    assert words[0] == words[4] and words[1] == words[3] and len(set(words.tolist())) == 3
    long = b"ab cd " * 400_000
    assert len(set(h.texts([long])[0].tolist())) == 2
    assert grams(words, 2)[0] != grams(words, 2)[3]


def test_awkward_rows(awkward, empty):
    check(AWKWARD, rlz.remove_repeats(awkward))
    assert rlz.remove_repeats(empty).collect() == []
