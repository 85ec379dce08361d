"""From documents to packed sequences: language, exact copies, near copies, mixing and packing.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written to the shared folder and read again as the next
one's documents. All but the last return the columns of documents. Every stage works on all that the one before kept; nothing is
looked up in sf_dir but the documents that `run` starts from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientlens.llm import exact_dedup, mixing, mixture_language, ngram_join, packing
from clientlens.llm.queries import VOCABULARY
from clientlens.llm.rows import partition_sizes, stored, without

LEAST_SHARE = 0.3  # of the likeliest language; with less, a text has no language
# Each document at most once: copies were removed on purpose.
MIX = mixing.Mix(percent=90, epochs=1)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: without a letter, or with no language that holds LEAST_SHARE of a text, it goes.

    Where `lang` is null it becomes the language that was found, so that the mix knows it. Null and empty texts go; repeated rows are judged alike.
    """
    name = "found_language"
    while name in docs.columns:
        name += "_"
    found = mixture_language.identify(docs, as_col=name)
    known = (F.col(f"{name}.lang_pred") != mixture_language.UNKNOWN) & (F.col(f"{name}.score") >= LEAST_SHARE)
    filled = {c: F.coalesce(found[f"`{c}`"], F.col(f"{name}.lang_pred")).alias(c) if c == "lang" else found[f"`{c}`"] for c in docs.columns}
    return found.where(known).select(*filled.values())


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id; of rows with one id and text a single one."""
    found = stored(exact_dedup.find_duplicates(docs).select("part", "place", "mark", "kept"), "copies")
    mark = F.xxhash64(exact_dedup.normalised(F.col("text")))
    return without(docs, mark, found.where("not kept").drop("kept"), partition_sizes(found))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by similar sets of five-word runs, the one with the smallest id; texts without words stay."""
    found = stored(ngram_join.near_duplicates(docs).select("part", "place", "mark", "kept"), "classes")
    return without(docs, F.xxhash64("text"), found.where("not kept").drop("kept"), partition_sizes(found))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that fill the target mix, each once at most; a null source is a node without name."""
    return mixing.mixed(docs, MIX)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences; rows with one id are packed each by itself."""
    return packing.pack_documents(docs, VOCABULARY)


STAGES = [("language", language), ("exact copies", exact_copies), ("near copies", near_copies), ("mix", mix), ("pack", pack)]

#: Languages, near copies by bands and token ids are beyond SQL; the tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
