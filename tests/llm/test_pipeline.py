from __future__ import annotations

import uuid
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as cp
import plain_language
from awkward_rows import AWKWARD
from clientlens.llm import mixing
from clientlens.llm.queries import VOCABULARY
from clientlens.llm.rows import stored
from clientlens.sources.workdir import shared_folder

SAMPLE = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet")
    kept = [docs]
    for name, stage in cp.STAGES:
        kept.append(stored(stage(spark, kept[-1], SAMPLE), "test"))
        if name != "pack":
            assert kept[-1].columns == docs.columns
    ids = [sorted(r.doc_id for r in d.select("doc_id").collect()) for d in kept[:-1]]
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(set(b) <= set(a) for a, b in zip(ids, ids[1:]))
    # language: these are documents with words of a known language each
    assert len(ids[1]) == len(ids[0])
    # exact copies: the largest id of each text
    groups = defaultdict(list)
    for i in ids[1]:
        groups["".join(c.lower() if c.isascii() else c for c in texts[i])].append(i)
    assert ids[2] == sorted(map(max, groups.values()))
    # near copies: no two that are left are similar, and none goes that was similar to no other
    words = {i: texts[i].encode().lower().split() for i in ids[2]}
    runs = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    alike = lambda a, b: len(runs[a] & runs[b]) >= 0.8 * len(runs[a] | runs[b])
    assert not [1 for a in ids[3] for b in ids[3] if a < b and alike(a, b)]
    for a in set(ids[2]) - set(ids[3]):
        assert [b for b in ids[2] if a != b and alike(a, b)]
    # mix: each document once at most
    assert len(set(ids[4])) == len(ids[4]) and 0.7 * len(ids[3]) < len(ids[4])
    # pack: all of them, once
    assert sorted(r.doc_id for r in kept[-1].where("piece = 0").collect()) == ids[4]


def copies(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def plain_language_stage(rows):
    model = plain_language.learned([(i, text, lang) for i, text, lang, _ in rows])
    kept = []
    for row in rows:
        share = plain_language.mixture(row[1], model)
        if share and max(share.values()) >= cp.LEAST_SHARE:
            kept.append((*row[:2], row[2] or max(share, key=share.get), row[3]))
    return Counter(kept)


def plain_mix(spark, docs):
    """How often each document is taken, by the SQL of the operator."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    docs.write.parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    rows = con.sql(f"SELECT doc_id, sum(copies) FROM ({mixing.mix_sql(cp.MIX)}) GROUP BY ALL").fetchall()
    return Counter({i: int(n) for i, n in rows if n})


def plain_pieces(docs):
    tokenizer, out = Tokenizer.from_file(VOCABULARY), Counter()
    for i, text in ((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            out[(i, piece, at, len(part), zlib.crc32(part.tobytes()))] += 1
    return out


def assert_gapless(packed):
    by_sequence = defaultdict(list)
    for r in packed.collect():
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def test_each_stage_equals_a_plain_version(spark, awkward):
    """On a sample table and on awkward rows; the two stages of copies are compared pair by pair in `test_stages`."""
    stages = dict(cp.STAGES)
    for docs in (spark.read.parquet(f"{SAMPLE}/documents.parquet"), awkward):
        columns = ("doc_id", "text", "lang", "source")
        known = stored(stages["language"](spark, docs, SAMPLE), "test")
        assert copies(known, *columns) == plain_language_stage([tuple(r) for r in docs.select(*columns).collect()])
        taken = stored(stages["mix"](spark, known, SAMPLE), "test")
        assert Counter({i: n for (i,), n in copies(taken, "doc_id").items()}) == plain_mix(spark, known.select(*columns))
        packed = stored(stages["pack"](spark, taken, SAMPLE), "test")
        assert copies(packed, "doc_id", "piece", "start", "length", "ids_crc32") == plain_pieces(taken)
        assert_gapless(packed)


def test_awkward_rows_go_through(spark, awkward, empty):
    """Texts with no letter go; of equal texts, and of rows that are equal, one stays; everything else is packed."""
    rows, ids = awkward, []
    for name, stage in cp.STAGES:
        rows = stored(stage(spark, rows, SAMPLE), "test")
        ids.append(sorted((r.doc_id is None, r.doc_id) for r in rows.select("doc_id").collect()))
    lettered = [i for i, text, _, _ in AWKWARD if any(c.isalpha() for c in text or "")]
    assert ids[0] == sorted((i is None, i) for i in lettered)
    # 1, 2, 2, 3 and a row without id have one text but for case; 7 and 8 have one
    assert [i for _, i in ids[1]] == [3, 8, 9, 10]
    assert ids[2] == ids[1]
    assert set(ids[4]) == set(ids[3]) <= set(ids[2])
    nothing = empty
    for _, stage in cp.STAGES:
        nothing = stored(stage(spark, nothing, SAMPLE), "test")
    assert nothing.count() == 0


def test_a_missing_language_is_filled_in(spark):
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet").selectExpr(
        "doc_id", "text", "IF(doc_id % 4 = 0, NULL, lang) AS lang", "source", "'mine' AS found_language", "lang AS true_lang"
    )
    rows = cp.language(spark, docs, SAMPLE).collect()
    assert {r.found_language for r in rows} == {"mine"} and len(rows) == docs.count()
    assert sum(r.lang == r.true_lang for r in rows) >= 0.98 * len(rows)


def test_texts_are_judged_once(spark, table, capsys):
    """A filter on the language found must not have Spark find it a second time, with two more workers a task."""
    docs = table("doc_id long, text string, lang string, source string, n_chars long", [(i, f"words of a text {i}", "en", "s", 9) for i in range(8)])
    found = cp.language(spark, docs, "")
    found.explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1
    assert found.count() == 8
