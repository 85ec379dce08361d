"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import stored


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node that it is linked with, directly or not) of `links` (a, b: long).

    In each round a node takes the smallest label of its neighbours and itself, and then the label of that label. Each round is written to the
    shared folder; the driver sees only whether anything changed.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("label", "near").alias("next"), "label")
        hop = labels.select(F.col("node").alias("via"), F.col("label").alias("further"))
        after = stored(
            lower.join(hop, F.col("next") == F.col("via")).select("node", F.least("next", "further").alias("label"), F.col("label").alias("old")), "labels"
        )
        labels = after.select("node", "label")
        if after.where("label <> old").limit(1).count() == 0:
            return labels.withColumnRenamed("label", "component")
