from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from clientlens.llm import mixing

from awkward_rows import AWKWARD

SAMPLE = "/root/testdata/sf0.001/documents.parquet"
MIXES = [mixing.Mix(), mixing.Mix(percent=90, epochs=1), mixing.Mix(percent=250, epochs=3), mixing.Mix(percent=0), mixing.Mix(percent=1000, epochs=2)]


@pytest.mark.parametrize("mix", MIXES)
def test_equals_sql(spark, mix):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SAMPLE}'")
    got = mixing.mix_counts(spark.read.parquet(SAMPLE), mix)
    want = sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({mixing.mix_sql(mix)})").fetchall())
    assert sorted(map(tuple, got.collect())) == want


def shares(spark, leaves, mix):
    df = spark.createDataFrame(leaves, "mix_domain string, mix_lang string, mix_source string, tokens long")
    return {(r.mix_domain, r.mix_lang, r.mix_source): r.budget for r in mixing.budgets(df, mix).collect()}


def test_shortage_goes_to_siblings_first(spark):
    mix = mixing.Mix(percent=50, epochs=1, domain_weights={}, lang_weights={}, source_weights={})
    leaves = [("a", "en", "x", 10), ("a", "en", "y", 500), ("b", "en", "z", 490)]
    # 500 tokens, 250 for each domain; x has 10 only, so y gets 240 and z nothing more.
    assert shares(spark, leaves, mix) == {("a", "en", "x"): 10, ("a", "en", "y"): 240, ("b", "en", "z"): 250}
    # If the whole of a has 20 only, the shortage goes to b.
    leaves = [("a", "en", "x", 10), ("a", "en", "y", 10), ("b", "en", "z", 980)]
    assert shares(spark, leaves, mix) == {("a", "en", "x"): 10, ("a", "en", "y"): 10, ("b", "en", "z"): 480}


def test_weights_go_down_the_tree(spark):
    mix = mixing.Mix(percent=10, epochs=1, domain_weights={"a": 3}, lang_weights={"en": 2}, source_weights={"x": 4})
    leaves = [(d, lang, s, 100_000) for d in "ab" for lang in ("en", "de") for s in ("x", "y")]
    total = sum(x[3] for x in leaves) // 10
    for (d, lang, s), budget in shares(spark, leaves, mix).items():
        want = total * {"a": 3 / 4, "b": 1 / 4}[d] * {"en": 2 / 3, "de": 1 / 3}[lang] * {"x": 4 / 5, "y": 1 / 5}[s]
        assert abs(budget - want) < 3


def test_no_python_in_the_plan(spark):
    for df in (mixing.mix_counts(spark.read.parquet(SAMPLE)), mixing.mixed(spark.read.parquet(SAMPLE))):
        plan = df._jdf.queryExecution().toString()
        assert not [x for x in ("Python", "Pandas", "Arrow", "ExistingRDD") if x in plan]


def test_a_leaf_never_exceeds_its_budget(spark):
    mix = mixing.Mix(percent=40, epochs=1)
    docs = spark.read.parquet(SAMPLE)
    rows = mixing.mix_counts(docs, mix)
    taken = rows.groupBy("domain", "lang", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used"), F.sum("tokens").alias("tokens"))
    leaves = taken.select(F.col("domain").alias("mix_domain"), F.col("lang").alias("mix_lang"), F.col("source").alias("mix_source"), "tokens", "used")
    for r in mixing.budgets(leaves, mix).collect():
        assert r.used <= r.budget


def test_awkward_rows(awkward, empty):
    counts = mixing.mix_counts(awkward, mixing.Mix(percent=300, epochs=4))
    assert counts.count() == len(AWKWARD)
    got = mixing.mixed(awkward, mixing.Mix(percent=300, epochs=4))
    assert got.columns == awkward.columns
    assert got.count() == counts.agg(F.sum("copies")).first()[0]
    assert mixing.mix_counts(empty).collect() == [] and mixing.mixed(empty).collect() == []
