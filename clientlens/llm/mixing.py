"""Mixing sources to target weights over a tree of domains, languages and sources.

The token budget goes down the tree: at each node it is shared among the children by their weights. A child
that cannot take its share (all its documents, as often as they may be repeated) takes what it can, and the shortage goes to its
siblings by their weights; only what a whole subtree cannot take is left to the siblings of its root.

A leaf takes its documents in the order of a seeded hash, as many whole epochs as its tokens allow and then a prefix of the next
epoch, which has an order of its own. The prefix ends at one hash value, the leaf's cut. Whether a document is taken can
so be told from the document and its leaf alone, without moving its text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rows import stored

LEAF = ("mix_domain", "mix_lang", "mix_source")
BUCKET = 3  # hexadecimal digits: a leaf's order is found for 4096 buckets, then inside one of them
ALL, NONE = "g", ""  # beyond and before all hexadecimal digits
WORD = r"[^\t\n\x0B\f\r ]+"

# Which sources make up a domain, and integer weights of nodes among their siblings (1 where none is given).
DOMAINS = {
    "web": [f"src{i}" for i in range(5)],
    "forum": [f"src{i}" for i in range(5, 10)],
    "reference": [f"src{i}" for i in range(10, 15)],
    "books": [f"src{i}" for i in range(15, 20)],
}
OTHER = "other"
DOMAIN_WEIGHTS = {"web": 4, "forum": 2, "reference": 3, "books": 3}
LANG_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 2}
SOURCE_WEIGHTS = {"src0": 2}


@dataclass(frozen=True)
class Mix:
    """A target: how many of all tokens, how often a document may be repeated, and the tree."""

    percent: int = 60
    epochs: int = 2
    seed: int = 8
    domains: dict = field(default_factory=lambda: DOMAINS)
    domain_weights: dict = field(default_factory=lambda: DOMAIN_WEIGHTS)
    lang_weights: dict = field(default_factory=lambda: LANG_WEIGHTS)
    source_weights: dict = field(default_factory=lambda: SOURCE_WEIGHTS)


def chosen(value: Column, results: dict, otherwise) -> Column:
    """The result for a value."""
    out = None
    for key, result in results.items():
        out = (F if out is None else out).when(value == key, F.lit(result))
    return F.lit(otherwise) if out is None else out.otherwise(F.lit(otherwise))


def leaf_columns(mix: Mix, lang_col: str, source_col: str) -> list[Column]:
    """The path of a document; a null language or source is a node without name."""
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    domain = chosen(source, {s: d for d, sources in mix.domains.items() for s in sources}, OTHER)
    return [domain.alias(LEAF[0]), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias(LEAF[1]), source.alias(LEAF[2])]


def key(mix: Mix, epoch: Column, doc_id: Column) -> Column:
    """A document's place in the order of an epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(mix.seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def share(children: DataFrame, parent: list[str], name: str, weights: dict) -> DataFrame:
    """`children` with `budget`, their parent's, replaced by their own share of it, at most their `room`.

    Children are ordered by room to weight. The first ones, whose room is below their share of what is left, take all their
    room; the others share the rest by weight. Nodes are few, so one task can hold the children of one.
    """
    by_parent = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    in_order = by_parent.orderBy(F.col("room") / F.col("weight"), name)
    before, after = in_order.rowsBetween(Window.unboundedPreceding, -1), in_order.rowsBetween(0, Window.unboundedFollowing)
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    return (
        children.withColumn("weight", chosen(F.col(name), weights, 1).cast("long"))
        .withColumn("taken", F.coalesce(F.sum("room").over(before), F.lit(0)))
        .withColumn("weights_left", F.sum("weight").over(after))
        .withColumn("full", exact("room") * exact("weights_left") <= (exact("budget") - exact("taken")) * exact("weight"))
        .withColumn("rest", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("room"))).over(by_parent), F.lit(0)))
        .withColumn("rest_weight", F.sum(F.when(~F.col("full"), F.col("weight"))).over(by_parent))
        .withColumn(
            "budget",
            F.when(F.col("full"), F.col("room")).otherwise(
                F.expr("cast(cast(rest as decimal(20,0)) * cast(weight as decimal(10,0)) div cast(rest_weight as decimal(20,0)) as long)")
            ),
        )
        .drop("weight", "taken", "weights_left", "full", "rest", "rest_weight")
    )


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """Leaves with their tokens and budget."""
    domain, lang, source = LEAF
    leaves = leaves.withColumn("room", F.col("tokens") * mix.epochs)
    total = leaves.agg((F.sum("tokens") * mix.percent).alias("t"), F.sum("room").alias("r")).select(
        F.least(F.floor(F.col("t") / 100).cast("long"), F.col("r")).alias("budget")
    )
    by_domain = leaves.groupBy(domain).agg(F.sum("room").alias("room")).join(F.broadcast(total))  # one row
    by_domain = share(by_domain, [], domain, mix.domain_weights).select(domain, "budget")
    by_lang = leaves.groupBy(domain, lang).agg(F.sum("room").alias("room")).join(by_domain, domain)
    by_lang = share(by_lang, [domain], lang, mix.lang_weights).select(domain, lang, "budget")
    return share(leaves.join(by_lang, [domain, lang]), [domain, lang], source, mix.source_weights).drop("room")


def cuts(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The documents without texts, and each leaf's epochs and cut."""
    slim = stored(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            *leaf_columns(mix, lang_col, source_col),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"),
        ),
        "tokens",
    )
    leaves = budgets(slim.groupBy(*LEAF).agg(F.sum("tokens").alias("tokens")), mix)
    has = F.col("tokens") > 0
    leaves = stored(
        leaves.select(
            *LEAF,
            F.when(has, F.expr("budget div tokens")).otherwise(F.lit(0)).alias("epochs"),
            F.when(has, F.expr("budget % tokens")).otherwise(F.lit(0)).alias("prefix"),
            has.alias("has"),
        ),
        "leaves",
    )
    keyed = slim.join(leaves, list(LEAF)).select(*LEAF, "tokens", "prefix", key(mix, F.col("epochs"), F.col("doc_id")).alias("key"))
    keyed = keyed.withColumn("bucket", F.substring("key", 1, BUCKET))
    leaf = Window.partitionBy(*LEAF)
    # For each leaf, the bucket in which its prefix ends, and the tokens before it.
    ends = stored(
        keyed.groupBy(*LEAF, "bucket", "prefix")
        .agg(F.sum("tokens").alias("tokens"))
        .withColumn("upto", F.sum("tokens").over(leaf.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
        .where("upto > prefix")
        .withColumn("nth", F.row_number().over(leaf.orderBy("bucket")))
        .where("nth = 1")
        .select(*LEAF, "bucket", (F.col("upto") - F.col("tokens")).alias("before")),
        "ends",
    )
    inside = (
        keyed.join(ends, [*LEAF, "bucket"])
        .withColumn("upto", F.col("before") + F.sum("tokens").over(leaf.orderBy("key").rangeBetween(Window.unboundedPreceding, 0)))
        .where("upto <= prefix")
        .groupBy(*LEAF)
        .agg(F.max("key").alias("last"))
    )
    cut = F.when(~F.col("has"), F.lit(ALL)).otherwise(F.coalesce("last", "bucket", F.lit(NONE)))
    return slim, stored(
        leaves.join(ends, list(LEAF), "left").join(inside, list(LEAF), "left").select(*LEAF, F.col("epochs").alias("mix_epochs"), cut.alias("mix_cut")), "cuts"
    )


def copies(mix: Mix, doc_id: Column) -> Column:
    """How often a document is taken, beside its leaf's epochs and cut."""
    return (F.col("mix_epochs") + (key(mix, F.col("mix_epochs"), doc_id) <= F.col("mix_cut")).cast("long")).alias("copies")


def mix_counts(docs: DataFrame, mix: Mix = Mix(), **columns: str) -> DataFrame:
    """One row per document: doc_id, domain, lang, source, tokens, copies (how often it is taken, 0 if not at all).

    Tokens are runs of anything but blanks. A leaf never gets more tokens than its budget: a document that would
    exceed it, and all after it, are left. Rows with one id stand at one place and are taken or left together. A leaf without
    tokens is taken once. A null text has no tokens. Other columns are not read. An empty table gives no rows.
    """
    slim, by_leaf = cuts(docs, mix, **columns)
    return slim.join(by_leaf, list(LEAF)).select(
        "doc_id", *(F.col(c).alias(c.removeprefix("mix_")) for c in LEAF), "tokens", copies(mix, F.col("doc_id"))
    )


def mixed(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The documents that are taken, as often as they are, with their columns. See `mix_counts`."""
    by_leaf = cuts(docs, mix, id_col, text_col, lang_col, source_col)[1]
    names = [c.alias(f"{c_name}_of") for c, c_name in zip(leaf_columns(mix, lang_col, source_col), LEAF)]
    with_leaf = docs.select("*", *names)
    on = [F.col(f"{c}_of") == F.col(c) for c in LEAF]
    repeated = F.explode(F.array_repeat(F.lit(1), copies(mix, F.col(id_col).cast("long")).cast("int"))).alias("mix_copy")
    return with_leaf.join(by_leaf, on).select(*(docs[f"`{c}`"] for c in docs.columns), repeated).drop("mix_copy")


def mix_sql(mix: Mix = Mix()) -> str:
    """`mix_counts` as plain SQL for DuckDB, without buckets or cuts."""

    def case(value: str, results: dict, otherwise: str) -> str:
        return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in results.items()) + f" ELSE {otherwise} END"

    def level(of: str, name: str, parent: str, parent_budgets: str, on: str, weights: dict) -> str:
        by = f"PARTITION BY {parent}" if parent else "PARTITION BY 1"
        return f"""
          SELECT * EXCLUDE (budget), CASE WHEN isfull THEN room ELSE CAST(
            (CAST(budget AS HUGEINT) - coalesce(sum(CASE WHEN isfull THEN room END) OVER (w0), 0)) * weight
            // sum(CASE WHEN NOT isfull THEN weight END) OVER (w0) AS BIGINT) END AS budget
          FROM (SELECT *, CAST(room AS HUGEINT) * sum(weight) OVER (w1 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
              <= (CAST(budget AS HUGEINT) - coalesce(sum(room) OVER (w1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS isfull
            FROM (SELECT c.*, p.budget, {case(name, weights, "1")} AS weight FROM ({of}) c JOIN ({parent_budgets}) p {on})
            WINDOW w1 AS ({by} ORDER BY CAST(room AS DOUBLE) / weight, {name}))
          WINDOW w0 AS ({by})"""

    domains = {s: f"'{d}'" for d, sources in mix.domains.items() for s in sources}
    blank = r"[^\t\n\x0B\f\r ]+"
    by_domain = level(
        "SELECT domain, CAST(sum(room) AS BIGINT) AS room FROM leaves GROUP BY domain", "domain", "",
        f"SELECT least(CAST(sum(tokens) AS HUGEINT) * {mix.percent} // 100, sum(room)) AS budget FROM leaves", "ON true", mix.domain_weights,
    )
    by_lang = level(
        "SELECT domain, lang, CAST(sum(room) AS BIGINT) AS room FROM leaves GROUP BY domain, lang", "lang", "domain",
        "SELECT domain, budget FROM by_domain", "USING (domain)", mix.lang_weights,
    )
    by_source = level(
        "SELECT * FROM leaves", "source", "domain, lang", "SELECT domain, lang, budget FROM by_lang", "USING (domain, lang)", mix.source_weights
    )
    return f"""
      WITH slim AS (SELECT doc_id, {case("coalesce(source, '')", domains, f"'{OTHER}'")} AS domain, coalesce(lang, '') AS lang,
          coalesce(source, '') AS source, CAST(coalesce(len(regexp_extract_all(text, '{blank}')), 0) AS BIGINT) AS tokens FROM documents),
        leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) * {mix.epochs} AS BIGINT) AS room
          FROM slim GROUP BY domain, lang, source),
        by_domain AS ({by_domain}),
        by_lang AS ({by_lang}),
        by_source AS ({by_source}),
        keyed AS (SELECT s.*, CASE WHEN b.tokens > 0 THEN b.budget // b.tokens ELSE 0 END AS epochs,
            CASE WHEN b.tokens > 0 THEN b.budget % b.tokens ELSE 0 END AS prefix FROM slim s JOIN by_source b USING (domain, lang, source)),
        placed AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source
            ORDER BY md5('{mix.seed}:' || epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null'))
            RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM keyed)
      SELECT doc_id, domain, lang, source, tokens, CAST(epochs + CASE WHEN upto <= prefix THEN 1 ELSE 0 END AS BIGINT) AS copies FROM placed"""
