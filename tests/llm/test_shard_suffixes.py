from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from awkward_rows import AWKWARD, COLUMNS, LONG
from hypothesis import given, settings
from hypothesis import strategies as st

from clientlens.llm import rows as rows_module
from clientlens.llm import shard_suffixes
from clientlens.llm.induced_sorting import permuted_common_prefixes, suffix_array

N = shard_suffixes.LENGTH


def plain(rows):
    """Every string in a dictionary."""
    least = {}
    texts = [(-(2**63) if i is None else i, i, (t or "").encode() if not isinstance(t, bytes) else t) for i, t in rows]
    for order, _, text in texts:
        for j in range(len(text) - N + 1):
            key = text[j : j + N]
            least[key] = min(least.get(key, order), order)
    out = []
    for order, i, text in texts:
        gone = bytearray(len(text))
        for j in range(len(text) - N + 1):
            if least[text[j : j + N]] < order:
                gone[j : j + N] = b"\1" * N
        spans, j = [], 0
        while j < len(gone):
            k = j
            while k < len(gone) and gone[k] == gone[j]:
                k += 1
            if gone[j]:
                spans.append((j, k))
            j = k
        kept = bytes(b for b, g in zip(text, gone) if not g)
        out.append((i, len(text), sum(gone), len(spans), hashlib.sha256(kept).hexdigest(), ",".join(f"{a}:{b}" for a, b in spans)))
    return sorted(map(str, out))


def found(df, **options):
    return sorted(str(tuple(r)) for r in shard_suffixes.remove_repeated_bytes(df, **options).collect())


def shuffled(seed: int, n: int = 40):
    """Texts of few symbols, copies, texts with shared passages, and runs of one letter."""
    rng = random.Random(seed)
    passages = ["".join(rng.choices("abc deé中", k=rng.randint(30, 90))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = ["".join(rng.choices("abcdefgh ", k=rng.randint(0, 60))) for _ in range(rng.randint(0, 5))]
        parts += rng.sample(passages, rng.randint(0, 3)) + (["a" * rng.randint(10, 300)] if rng.random() < 0.2 else [])
        rng.shuffle(parts)
        rows.append((rng.randint(0, 2 * n), "".join(parts), None, None))
    return rows + [(3 * n + k, rows[k][1], None, None) for k in range(5)]


@pytest.mark.parametrize("seed", range(3))
def test_equals_plain_search(table, seed):
    rows = shuffled(seed)
    assert found(table(COLUMNS, rows)) == plain([(i, t) for i, t, _, _ in rows])


def test_awkward_rows(awkward):
    assert found(awkward) == plain([(i, t) for i, t, _, _ in AWKWARD])


def test_empty_table(empty, spark):
    assert found(empty) == []
    assert found(spark.createDataFrame([(1, None, None, None), (2, "short", None, None)], COLUMNS)) == plain([(1, None), (2, "short")])


def test_sizes_do_not_matter(table, monkeypatch):
    """Chunks, owners and shards of a few bytes, and anchors that a shard does not hold."""
    rows = shuffled(9)
    df, wanted = table(COLUMNS, rows), plain([(i, t) for i, t, _, _ in rows])
    for name, size in (("CHUNK", 900), ("AT_ONCE", 300), ("OWNED", 1000), ("SHARD", 5000)):
        monkeypatch.setattr(shard_suffixes, name, size)
    assert found(df) == wanted
    monkeypatch.setattr(shard_suffixes, "SHARD", 60)  # nearly every anchor is settled string by string
    assert found(df) == wanted


def test_malformed_bytes_count_as_they_are(spark):
    passage = "66ff00" * 30
    df = spark.sql(f"SELECT 1L AS doc_id, CAST(X'{passage}' AS STRING) AS text UNION ALL SELECT 2L, CAST(X'00{passage}00' AS STRING)")
    path = f"{rows_module.shared_folder(spark)}/malformed"
    df.write.mode("overwrite").parquet(path)
    data = bytes.fromhex(passage)
    assert found(spark.read.parquet(path)) == plain([(1, data), (2, b"\0" + data + b"\0")])


def test_a_passage_of_a_third_of_all_rows(table):
    passage = LONG[:400]
    rows = [(i, (LONG[i * 30 : i * 30 + 200] + passage if i % 3 == 0 else f"{i} " * 20), None, None) for i in range(300)]
    assert found(table(COLUMNS, rows)) == plain([(i, t) for i, t, _, _ in rows])


def test_scans_are_cut_alike_when_cores_come_and_go(table, spark, monkeypatch):
    """Splits follow the number that was fixed by the first scan, not the cores alive now."""
    spark.conf.unset("spark.sql.files.minPartitionNum")
    rows = shuffled(4)
    df = table(COLUMNS, rows)
    rows_module.fix_splits(spark)
    before = df.rdd.getNumPartitions()
    alive = type(spark.sparkContext).defaultParallelism
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", property(lambda sc: 2))
    rows_module.fix_splits(spark)
    assert spark.conf.get("spark.sql.files.minPartitionNum") == "8"
    assert df.select("*").rdd.getNumPartitions() == before
    assert found(df) == plain([(i, t) for i, t, _, _ in rows])
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", alive)


texts = st.lists(st.integers(1, 4), max_size=60)


@settings(max_examples=200, deadline=None)
@given(texts, st.integers(1, 4))
def test_suffix_array(symbols, times):
    text = np.array(symbols * times + [0], dtype=np.uint16)
    assert suffix_array(text, 5).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


@settings(max_examples=100, deadline=None)
@given(texts, st.integers(1, 4))
def test_common_prefixes(symbols, times):
    data = np.array(symbols * times, dtype=np.uint8)
    array = suffix_array(np.append(data, 0).astype(np.uint16), 5)
    common, before = permuted_common_prefixes(data, array)
    for i, (n, j) in enumerate(zip(common.tolist(), before.tolist())):
        if j >= 0:
            same = [a == b for a, b in zip(data[i:].tolist(), data[j:].tolist())] + [False]
            assert n == same.index(False)


def test_names_of_many_digits():
    rng = np.random.default_rng(2)
    words = rng.integers(1, 250, (900, 9))
    text = np.append(words[rng.integers(0, 900, 4000)].ravel(), 0).astype(np.uint16)
    array = suffix_array(text, 250)
    data = text[:-1].astype(np.uint8).tobytes()
    assert array[1:].tolist() == sorted(range(len(data)), key=lambda i: data[i : i + 400])
