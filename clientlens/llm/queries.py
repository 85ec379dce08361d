"""The operators as registered queries over the sample tables, and those of them that SQL can express.

Each query applies its operator to a whole table and returns all that it finds.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cross_polytope, delta_kmeans, exact_dedup, licenses, line_crf, mixing, mixture_language, ngram_join, packing, pii, rlz, shard_suffixes, token_alignment

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_LEVEL, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixture_language.identify(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", mixture_language.held_out().alias("held_out"), "language.*")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_duplicates(table(spark, sf_dir, "documents")).drop("part", "place", "mark")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licences(table(spark, sf_dir, "documents")).select("doc_id", "licence.*")


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = line_crf.learn(docs, table(spark, sf_dir, "labels"))
    scored = line_crf.score_quality(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", line_crf.held_out().alias("held_out"), "score", (F.col("score") >= line_crf.THRESHOLD).cast("int").alias("predicted")
    )


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents")).select("doc_id", "personal.*")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies", "kept")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), VOCABULARY)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(table(spark, sf_dir, "documents"))


def op9_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz.remove_repeats(table(spark, sf_dir, "documents")).drop("factors")


def op11_delta_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta_kmeans.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op12_shard_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_suffixes.remove_repeated_bytes(table(spark, sf_dir, "documents")).drop("spans")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_documents(table(spark, sf_dir, "documents"), BYTE_LEVEL, PIECES)


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_mixture,
        op2_exact_dedup,
        op3_license_scan,
        op4_line_quality,
        op5_personal_data,
        op6_ngram_join,
        op7_best_fit_packing,
        op8_source_mixing,
        op9_cross_polytope,
        op10_substring_dedup,
        op11_delta_kmeans,
        op12_shard_suffixes,
        op13_token_alignment,
    )
}

_LOWER = f"translate(coalesce(text, ''), '{exact_dedup.UPPER}', '{exact_dedup.LOWER}')"

ORACLE = {
    "op2_exact_dedup": f"""
      WITH t AS (SELECT doc_id, {_LOWER} AS x FROM documents)
      SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
        row_number() OVER (PARTITION BY x ORDER BY doc_id DESC) = 1 AS kept, sha256(x) AS text_sha256
      FROM t WINDOW w AS (PARTITION BY x)""",
    "op6_ngram_join": f"""
      WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\\t\\n\\x0B\\f\\r ]+'), lambda x: x <> '') AS w FROM documents),
        runs AS (SELECT doc_id, CASE WHEN len(w) < {ngram_join.RUN} THEN [w]
          ELSE list_transform(range(1, len(w) - {ngram_join.RUN} + 2), lambda i: w[i : i + {ngram_join.RUN} - 1]) END AS r FROM words WHERE len(w) > 0),
        sets AS (SELECT doc_id, list_sort(list_distinct(r)) AS s FROM runs),
        distinct_sets AS (SELECT min(doc_id) AS node, count(*) AS n_copies, s FROM sets GROUP BY s),
        items AS (SELECT node, unnest(s) AS run FROM distinct_sets),
        common AS (SELECT x.node AS a, y.node AS b, count(*) AS c FROM items x JOIN items y ON x.run = y.run AND x.node <> y.node GROUP BY ALL),
        links AS (SELECT a, b FROM common JOIN distinct_sets p ON p.node = a JOIN distinct_sets q ON q.node = b
          WHERE c >= {ngram_join.SIMILARITY} * (len(p.s) + len(q.s) - c) - 1e-9),
        reach(node, other) AS (SELECT node, node FROM distinct_sets UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
        classes AS (SELECT node, min(other) AS class_id FROM reach GROUP BY node),
        linked AS (SELECT a AS node, sum(n_copies) AS n FROM links JOIN distinct_sets ON node = b GROUP BY a),
        placed AS (SELECT doc_id, class_id, CAST(n_copies - 1 + coalesce(n, 0) AS BIGINT) AS n_links, n_copies
          FROM sets JOIN distinct_sets USING (s) JOIN classes USING (node) LEFT JOIN linked USING (node)
          UNION ALL SELECT doc_id, doc_id, 0, 1 FROM words WHERE len(w) = 0)
      SELECT doc_id, class_id, n_links, n_copies, doc_id = class_id AS kept FROM placed""",
    "op8_source_mixing": mixing.mix_sql(),
    "op10_substring_dedup": f"""
      WITH t AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\t\\n\\x0B\\f\\r ]+'), lambda x: x <> '') AS w FROM documents),
        words AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j, w FROM t),
        windows AS (SELECT doc_id, n, word, j, CASE WHEN j + {rlz.WINDOW} - 1 <= n THEN array_to_string(w[j : j + {rlz.WINDOW} - 1], ' ') END AS key FROM words),
        judged AS (SELECT *, CASE WHEN key IS NOT NULL AND row_number() OVER (PARTITION BY key ORDER BY doc_id, j) > 1 THEN 1 ELSE 0 END AS again FROM windows),
        covered AS (SELECT *, max(again) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN {rlz.WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM judged),
        done AS (SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (gone = 0) AS kept FROM covered GROUP BY doc_id)
      SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
      FROM t LEFT JOIN done USING (doc_id)""",
    "op11_delta_kmeans": delta_kmeans.cluster_sql(),
    "op12_shard_suffixes": shard_suffixes.repeats_sql(),
}
