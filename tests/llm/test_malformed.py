"""Texts that are no valid UTF-8, in every operator that hands texts to Python."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from clientlens.llm import licenses, line_crf, mixture_language, ngram_join, packing, pii, rlz
from clientlens.llm.queries import VOCABULARY
from clientlens.llm.rows import stored
from clientlens.sources.workdir import shared_folder

PROSE = "It was of the thing that ought to be here, and the rest of them were only waiting for it, a@b.co says under the MIT license."


@pytest.fixture(scope="module")
def malformed(spark):
    """The same prose well formed, with a stray byte, cut inside a character, and nothing but stray bytes."""
    texts = {1: PROSE.encode(), 2: PROSE.encode() + b"\xff", 3: b"\xc3" + PROSE.encode(), 4: b"\xff\xfe\xff", 5: None}
    rows = " UNION ALL ".join(f"SELECT {i}L AS doc_id, CAST({'NULL' if t is None else f'''X'{t.hex()}' '''} AS STRING) AS text" for i, t in texts.items())
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    spark.sql(f"SELECT *, 'en' AS lang, 'src1' AS source FROM ({rows})").write.parquet(path)
    return spark.read.parquet(path)


def replaced(docs):
    return docs.withColumn("text", F.make_valid_utf8("text"))


@pytest.mark.parametrize(
    "operator",
    [
        lambda d: mixture_language.identify(d).select("doc_id", "language"),
        lambda d: licenses.find_licences(d).select("doc_id", "licence"),
        lambda d: pii.find_personal_data(d).select("doc_id", "personal"),
        lambda d: line_crf.score_quality(d, line_crf.learn(d, d.selectExpr("doc_id", "int(doc_id % 2) AS quality"))).select("doc_id", "score"),
        lambda d: packing.pack_documents(d, VOCABULARY).drop("sequence_id", "offset"),
    ],
    ids=["language", "licences", "personal", "quality", "packing"],
)
def test_read_with_replacement_characters(malformed, operator):
    found = sorted(operator(malformed).collect(), key=str)
    assert found == sorted(operator(replaced(malformed)).collect(), key=str)
    assert {r[0] for r in found} == {1, 2, 3, 4, 5}


def test_near_copies_and_repeats(malformed, spark):
    near = {r.doc_id: r.class_id for r in ngram_join.near_duplicates(malformed).collect()}
    assert near[1] == near[2] == near[3] == 1 and near[4] == 4
    assert rlz.remove_repeats(malformed).count() == 5


def test_pipeline(malformed, spark):
    more = [(i, " ".join(f"w{chr(97 + i)}{chr(97 + k % 26)}{k}" for k in range(40)), "en", "src1") for i in range(6, 26)]
    rows = stored(malformed.unionByName(spark.createDataFrame(more, malformed.schema)), "test")
    for _, stage in cp.STAGES:
        rows = stored(stage(spark, rows, ""), "test")
    found = {r.doc_id for r in rows.collect()}
    assert not found & {2, 3, 4, 5} and len(found) >= 15
