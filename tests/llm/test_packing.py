from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from clientlens.llm import packing
from clientlens.llm.queries import VOCABULARY

from awkward_rows import AWKWARD

BITS = ["a", "B", "'S", "'t", "don't", " ", "\n", "\t", "é", "É", "ß", "12", "!!", "$,", "’", "Σ", "İ", "́", "<|endoftext|>", "\xa0", "\x1c", "\x85", "—", "中", "½", "\r\n", "€", "\0", "þÞ"]


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return t


def test_ids_are_those_of_the_tokenizer(tokenizer):
    rng, words = random.Random(3), packing.Words(VOCABULARY)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 20))) for _ in range(1500)] + [None, ""]
    for i in range(0, len(texts), 50):
        for text, ids in zip(texts[i : i + 50], words.ids(texts[i : i + 50])):
            assert np.frombuffer(ids, "<u4").tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END], repr(text)


def test_memory_may_be_small(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 3)
    words = packing.Words(VOCABULARY)
    for text in ("one two three four", "five six one", "one two", ""):
        assert np.frombuffer(words.ids([text])[0], "<u4").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=80), st.sampled_from(["norm", "dot"]), st.integers(1, 6))
def test_capacities_hold(lengths, rule, documents):
    limit = packing.Capacity(tokens=100, documents=documents, attention=10_000, rule=rule)
    lengths = np.array(sorted(lengths, reverse=True), dtype=np.int64)
    sequence, offset = packing.best_fit(lengths, limit)
    for s in set(sequence.tolist()):
        own = np.flatnonzero(sequence == s)
        assert lengths[own].sum() <= 100 and len(own) <= documents and (lengths[own] ** 2).sum() <= 10_000
        at = own[np.argsort(offset[own])]
        assert offset[at].tolist() == (np.cumsum(lengths[at]) - lengths[at]).tolist()


def test_best_fit_is_near_the_bound():
    lengths = np.sort(np.random.default_rng(1).integers(1, 2049, 3000))[::-1]
    sequence, _ = packing.best_fit(lengths, packing.Capacity())
    assert sequence.max() + 1 <= 1.02 * lengths.sum() / 2048 + 1


def check(rows, got, tokenizer, tokens=2048):
    ids = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for _, t, *_ in rows]
    want = sorted(
        str((r[0], k, at, len(x[at : at + tokens]), zlib.crc32(np.array(x[at : at + tokens], "<u4").tobytes())))
        for r, x in zip(rows, ids)
        for k, at in enumerate(range(0, len(x), tokens))
    )
    assert sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= tokens


def test_awkward_rows(awkward, empty, tokenizer):
    check(AWKWARD, packing.pack_documents(awkward, VOCABULARY).collect(), tokenizer)
    assert packing.pack_documents(empty, VOCABULARY).collect() == []


def test_several_groups(table, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 20)
    rng = random.Random(4)
    rows = [(i % 150, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    limit = packing.Capacity(tokens=64, documents=8, attention=64 * 64)
    check(rows, packing.pack_documents(table("doc_id long, text string", rows), VOCABULARY, limit).collect(), tokenizer, 64)


def test_capacity_must_take_a_piece(awkward):
    with pytest.raises(ValueError):
        packing.pack_documents(awkward, VOCABULARY, packing.Capacity(attention=5))


def test_added_tokens_are_those_of_the_plain_tokenizer(table):
    plain = Tokenizer.from_file(VOCABULARY)
    assert plain.encode("end <|endoftext|> of", add_special_tokens=False).ids == [806, 49407, 539]
    rows = [(1, "end <|endoftext|> of"), (2, "<|startoftext|>" * 3 + " don't"), (3, "end <|ENDOFTEXT|> of"), (4, "<|endoftext"), (5, "中<|endoftext|>")]
    check(rows, packing.pack_documents(table("doc_id long, text string", rows), VOCABULARY).collect(), plain)
    rng, words = random.Random(7), packing.Words(VOCABULARY, added=True)
    for _ in range(300):
        text = "".join(rng.choice([*BITS, "<|startoftext|>", "<|", "|>"]) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(words.ids([text])[0], "<u4").tolist() == [*plain.encode(text, add_special_tokens=False).ids, packing.END], repr(text)


def test_groups_follow_pieces(table, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 20)
    counts = []
    real = packing.pack
    monkeypatch.setattr(packing, "pack", lambda parts, n, capacity: counts.append((parts.count(), n)) or real(parts, n, capacity))
    # Few documents of many pieces, and many short ones: only pieces that are not full are dealt to groups.
    rows = [(i, "alpha beta " * 500) for i in range(3)] + [(i, "alpha " * (i % 9)) for i in range(3, 103)]
    limit = packing.Capacity(tokens=32, documents=8, attention=32 * 32)
    got = packing.pack_documents(table("doc_id long, text string", rows), VOCABULARY, limit).collect()
    check(rows, got, tokenizer, 32)
    assert counts == [(103, 6)]
    full = [r for r in got if r.length == 32]
    assert len(full) == 3 * 31 and {r.offset for r in full} == {0} and len({r.sequence_id for r in full}) == len(full)
