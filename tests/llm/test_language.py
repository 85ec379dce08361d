from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from clientlens.llm import mixture_language as ml

import plain_language
from awkward_rows import AWKWARD

SAMPLE = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = ml.identify(spark.read.parquet(f"{SAMPLE}/documents.parquet"))
    right = docs.where(ml.held_out()).agg(F.avg((F.col("lang") == F.col("language.lang_pred")).cast("int"))).first()[0]
    assert right > 0.98


def test_mixture_of_two(spark):
    langs, table = ml.learn(spark.read.parquet(f"{SAMPLE}/documents.parquet"))
    texts = {r.lang: r.text for r in spark.read.parquet(f"{SAMPLE}/documents.parquet").where("length(text) between 900 and 1100").collect()}
    docs = spark.createDataFrame([(texts["de"] + " " + texts["fr"],), (texts["de"],)], "text string")
    both, one = docs.select(ml.predictor(langs, table)("text").alias("p")).select("p.*").collect()
    assert both.n_languages == 2 and 0.35 < both.score < 0.65
    assert {x.split(":")[0] for x in both.mixture.split(",")} == {"de", "fr"}
    assert (one.lang_pred, one.n_languages) == ("de", 1)


def test_em_finds_planted_shares():
    rng = np.random.default_rng(3)
    of = rng.choice(3, 400, p=[0.7, 0.3, 0.0])
    like = np.full((400, 3), -10.0)
    like[np.arange(400), of] = -2.0
    share = ml.mixtures(like, np.array([0]))[0]
    assert abs(share[0] - (of == 0).mean()) < 0.02 and share[2] == 0


def test_awkward_rows(awkward):
    got = ml.identify(awkward).select("doc_id", "text", "language.*").collect()
    assert len(got) == 14
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == ml.UNKNOWN) == (not letters)
        assert 0 <= r.score <= 1 and (letters or r.score == 0)


def test_nothing_to_learn_from(awkward, empty):
    unlabelled = awkward.withColumn("lang", F.lit(None).cast("string"))
    assert {r[0] for r in ml.identify(unlabelled).select("language.lang_pred").collect()} == {ml.UNKNOWN}
    assert ml.identify(empty).collect() == []


def test_language_of_held_out_rows_is_not_read(spark):
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet")
    other = docs.withColumn("lang", F.when(ml.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    one, two = (sorted(map(tuple, ml.identify(d).select("doc_id", "language.lang_pred", "language.score").collect())) for d in (docs, other))
    assert one == two


def assert_plain(found, rows):
    model = plain_language.learned([(i, text, lang) for i, text, lang in rows])
    wanted = sorted(((i, text), plain_language.mixture(text, model)) for i, text, _ in rows)
    got = sorted((((r.doc_id, r.text), r) for r in found), key=lambda x: x[0])
    assert len(got) == len(wanted)
    for (key, r), (wanted_key, share) in zip(got, wanted):
        assert key == wanted_key
        if not share:
            assert (r.lang_pred, r.score, r.mixture) == (ml.UNKNOWN, 0.0, "")
            continue
        assert r.lang_pred == max(share, key=share.get) and r.n_languages == len(share)
        assert abs(r.score - max(share.values())) < 0.005
        for lang, s in share.items():
            assert abs(float(dict(x.split(":") for x in r.mixture.split(","))[lang]) - s) < 0.005


def test_equals_plain_mixtures(spark):
    """Trigrams, segments, expectation-maximisation and penalties counted one by one, over a whole table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert_plain(ml.identify(docs).select("doc_id", "text", "language.*").collect(), [(r.doc_id, r.text, r.lang) for r in docs.collect()])


def test_awkward_rows_equal_plain_mixtures(table):
    rows = [(i, text, lang) for i, text, lang, _ in AWKWARD if i is not None and text is not None]
    df = table("doc_id long, text string, lang string", rows, ("language_of", "score", "a.b"))
    assert_plain(ml.identify(df).select("doc_id", "text", "language.*").collect(), rows)


def test_a_column_of_the_results_name_is_replaced(spark):
    """`as_col` names the result; a column that is called so goes."""
    docs = spark.createDataFrame([(1, "the thing and the other", "en", "mine")], "doc_id long, text string, lang string, language string")
    assert ml.identify(docs).select("language.lang_pred").first()[0] == "en"
    kept = ml.identify(docs, as_col="found").select("language", "found.lang_pred").first()
    assert tuple(kept) == ("mine", "en")
