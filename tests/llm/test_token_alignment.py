from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer, pre_tokenizers

from awkward_rows import AWKWARD, COLUMNS, LONG
from clientlens.llm import token_alignment
from clientlens.llm.token_alignment import First, slices, vocabularies, written
from clientlens.llm.queries import BYTE_LEVEL, PIECES


@pytest.fixture(scope="module")
def plain():
    """Alignment token by token, with offsets walked side by side."""
    first, second = Tokenizer.from_file(BYTE_LEVEL), SentencePieceProcessor(model_file=PIECES)
    first.encode_special_tokens = True
    alphabet = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    char_of = {b: alphabet.pre_tokenize_str(chr(b))[0][0] for b in range(128)}

    def decode_first(name: str) -> bytes:
        back = {c: b for b, c in char_of.items()}
        if all(c in back for c in name):
            return bytes(back[c] for c in name)
        from clientlens.llm.token_alignment import byte_level

        return bytes(byte_level()[c] for c in name)

    def decode_second(i: int) -> bytes:
        piece = second.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()

    def groups(text):
        if not text:
            return []
        a = first.encode(" " + text, add_special_tokens=False).ids
        b = second.encode(text)
        bytes_a, bytes_b = [decode_first(first.id_to_token(i)) for i in a], [decode_second(i) for i in b]
        if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            return []
        out, own_a, own_b, i, j, at_a, at_b = [], [], [], 0, 0, 0, 0
        while i < len(a) or j < len(b):
            if at_a <= at_b and i < len(a):
                own_a.append(a[i])
                at_a += len(bytes_a[i])
                i += 1
            else:
                own_b.append(b[j])
                at_b += len(bytes_b[j])
                j += 1
            if at_a == at_b and own_a and own_b:
                out.append((own_a, own_b))
                own_a, own_b = [], []
        return out

    def table(rows):
        found = [(i, groups(text)) for i, text in rows]
        linked = [[(x, y) for a, b in own for x in a for y in b] for _, own in found]
        count = Counter(p for pairs in linked for p in set(pairs))
        best = {}
        for (x, _), n in count.items():
            best[x] = max(best.get(x, 0), n)
        out = []
        for (i, own), pairs in zip(found, linked):
            shown = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in own)
            out.append((
                i, sum(len(a) for a, _ in own), sum(len(b) for _, b in own), len(own), len(pairs),
                sum(count[p] == best[p[0]] for p in pairs), sum(count[p] for p in pairs),
                hashlib.sha256(shown.encode()).hexdigest() if own else "",
            ))
        return sorted(map(str, out))

    return table


def found(df, **options):
    return sorted(str(tuple(r)) for r in token_alignment.align_documents(df, BYTE_LEVEL, PIECES, **options).collect())


def test_equals_plain_alignment(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert found(docs) == plain([(r.doc_id, r.text) for r in docs.collect()])


def test_awkward_rows(awkward, plain):
    assert found(awkward) == plain([(i, text) for i, text, _, _ in AWKWARD])


def test_odd_texts(table, plain):
    texts = ["<|endoftext|> and <s> </s> <unk> ▁ here", " leading", "trailing ", "two  blanks", "tab\there\n\nline", "nul\0inside", "🙂🙂 ǅ ﬁ ½ Ａ",
             "é ­ soft", "中文字符 العربية", "﻿x", "a" * 3000, "1234567890" * 20, "​zero"]
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    assert found(table(COLUMNS, rows)) == plain([(i, t) for i, t, _, _ in rows])


def test_blocks_do_not_matter(table, plain, monkeypatch):
    rows = [(i, f"{LONG[i * 50 : i * 50 + 400]} the same {i % 3}", None, None) for i in range(60)]
    monkeypatch.setattr(token_alignment, "BLOCK", 700)
    monkeypatch.setattr(token_alignment, "AT_ONCE", 900)
    assert found(table(COLUMNS, rows)) == plain([(i, t) for i, t, _, _ in rows])


def test_malformed_text_has_no_tokens(spark, plain):
    df = spark.sql("SELECT 1L AS doc_id, CAST(X'616263ff20' AS STRING) AS text UNION ALL SELECT 2L, 'well formed'")
    assert found(df) == sorted(plain([(2, "well formed")]) + [str((1, 0, 0, 0, 0, 0, 0, ""))])


def test_empty_table(empty):
    assert found(empty) == []


def test_only_texts_without_tokens(table, plain):
    rows = [(i, text, None, None) for i, text in enumerate([None, "", None, ""])]
    assert found(table(COLUMNS, rows)) == plain([(i, t) for i, t, _, _ in rows])


def test_pair_counts(table, spark):
    docs = table(COLUMNS, [(1, "the cat", None, None), (2, "the cat the cat", None, None), (3, "a dog", None, None)])
    counts = token_alignment.pair_counts(token_alignment.align_blocks(docs, BYTE_LEVEL, PIECES)).collect()
    tokens = Tokenizer.from_file(BYTE_LEVEL).encode(" the", add_special_tokens=False).ids
    assert [(r.documents, r.best) for r in counts if r.a == tokens[0]] == [(2, 1)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"])), max_size=5), st.lists(st.text("ab's t're 1²½\n\t .ÄéЖ中가\u00a0", max_size=40), max_size=5))
def test_ids_are_those_of_the_vocabularys_tokenizer(strange, usual):
    first, own = vocabularies(BYTE_LEVEL, PIECES)[0], Tokenizer.from_file(BYTE_LEVEL)
    own.encode_special_tokens = True
    assert first.ranked is not None
    for texts in (strange, usual, ["<|endoftext|>", "x <|endoftext|>y"]):
        assert [x.tolist() for x in first.encode(texts)] == [own.encode(" " + t, add_special_tokens=False).ids for t in texts]


def test_each_usual_character_is_encoded_alike():
    first, own = vocabularies(BYTE_LEVEL, PIECES)[0], Tokenizer.from_file(BYTE_LEVEL)
    usual = [c for c in map(chr, range(0xD800)) if not First.ODD.search(c)]
    assert len(usual) > 30_000
    for some in (usual[i : i + 500] for i in range(0, len(usual), 500)):
        text = " ".join(f"a{c}1{c}.{c} {c}{c}" for c in some)
        assert first.encode([text])[0].tolist() == own.encode(" " + text, add_special_tokens=False).ids


def test_vocabularies_are_parameters():
    assert public_tokenizers.path("byte_bpe_50k.json") == BYTE_LEVEL


def test_groups_of_random_tokens():
    """Offsets looked up in direct tables give the groups that dictionaries give, also with tokens of no bytes; ids are written from a table too."""
    rng, shown = np.random.default_rng(3), vocabularies(BYTE_LEVEL, PIECES)[2]
    n, m = (vocabularies(BYTE_LEVEL, PIECES)[k].bytes.sizes.size for k in (0, 1))
    for _ in range(300):
        sizes = [rng.integers(0, 4, rng.integers(0, 30)) for _ in range(2)]
        for own, other in (sizes, sizes[::-1]):
            sizes[0 if own is sizes[0] else 1] = np.append(own, max(0, other.sum() - own.sum()))
        a, b = (rng.integers(0, k, len(x)) for k, x in zip((n, m), sizes))
        ends = [np.cumsum(x) for x in sizes]
        index = [dict(zip(x.tolist(), range(1, len(x) + 1))) for x in ends]
        common = sorted(index[0].keys() & index[1].keys())
        stops = slices(*ends)
        assert [x.tolist() for x in stops] == [[i[c] for c in common] for i in index]
        assert all(x.dtype == np.int64 for x in stops)
        cut = [np.split(x, stop)[:-1] for x, stop in zip((a, b), stops)]
        if all(len(x) for x in cut[0]) and all(len(x) for x in cut[1]):
            plain = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in zip(*cut))
            assert written(a, b, *stops, shown, n, m) == plain
    assert shown.dtype.kind == "S"  # one table, not a list of strings


def test_rows_of_blocks_are_smaller_than_their_text(spark, monkeypatch):
    """As Spark holds them, and a file's row group, which a task holds whole, has few of them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1)
    monkeypatch.setattr(token_alignment, "BLOCK", 200_000)
    blocks = token_alignment.align_blocks(docs, BYTE_LEVEL, PIECES)
    rows, size = blocks.toArrow(), sum(len((r.text or "").encode()) for r in docs.collect())
    assert rows.num_rows >= 10
    assert rows.nbytes < 0.75 * size
    groups = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in blocks.inputFiles()]
    most = max(m.row_group(g).num_rows for m in groups for g in range(m.num_row_groups))
    assert most <= 8
