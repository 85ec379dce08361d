"""Talking back to the rows of a scan without moving them.

Some methods let the partitions of a table send small messages (hashes, seeds), and later answer each
partition about its own rows. `Scan` names each row by its partition and its place there, and `attach` hands
each row the answer that was sent to it. Only the answers are shuffled, never the rows.

The table must be one that gives its rows in the same order when it is read again: files, or a
checkpoint. Each answer carries the row's mark (any hash of its content), and a mismatch fails the job instead
of giving wrong rows. Files are cut into partitions by a number that Spark else takes from the cores alive at the time: it is fixed with
the first scan, so that executors lost or won between two scans do not cut them anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clientlens.sources.workdir import shared_folder


def stored(df: DataFrame, name: str, compression: str = "snappy", **options: object) -> DataFrame:
    """Written to the shared folder, with options of the writer, and read again: what follows does not depend on executors living on."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def fix_splits(spark: SparkSession) -> None:
    """Let all scans of this session cut files alike, however many cores are alive."""
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))


PLACE_BITS = 33  # monotonically_increasing_id() is the partition's number and 33 bits of place


class Scan:
    """The rows of a table with a mark, which is any hash of a row's content; `row` numbers them."""

    def __init__(self, df: DataFrame, mark: str = "mark"):
        fix_splits(df.sparkSession)
        self.df = df.withColumn("row", F.monotonically_increasing_id())
        self.mark, self.at = mark, df.columns.index(mark)

    def places(self, *columns: str) -> DataFrame:
        """row, part, place and mark of every row, and the named columns."""
        return self.df.select(
            "row",
            F.shiftright("row", PLACE_BITS).cast("int").alias("part"),
            F.col("row").bitwiseAND(2**PLACE_BITS - 1).alias("place"),
            self.mark,
            *columns,
        )

    def attach(self, answers: DataFrame, sizes: DataFrame) -> RDD:
        """Pairs (row, answer) of all rows; the answer is None for rows that got none.

        `answers`: part, place, mark, then the columns of the answer, one row for a place at most.
        `sizes`: part and n, the number of rows of each partition.
        """
        rows, at = self.df.rdd.map(tuple), self.at
        sent = answers.rdd.map(lambda a: (a[0], tuple(a)[1:])).union(sizes.rdd.map(lambda s: (s[0], (-1, s[1]))))

        def in_order(messages: Iterator) -> Iterator:
            got, n = {}, 0
            for _, m in messages:
                if m[0] < 0:
                    n = m[1]
                else:
                    got[m[0]] = m[1:]
            return (got.get(place) for place in range(n))

        def checked(pair: tuple) -> tuple:
            row, answer = pair
            if answer is None:
                return row, None
            if answer[0] != row[at]:
                raise RuntimeError("the table gave its rows in another order; read it from files or a checkpoint")
            return row, answer[1:]

        placed = sent.partitionBy(max(1, rows.getNumPartitions()), int).mapPartitions(in_order)
        if more := placed.getNumPartitions() - rows.getNumPartitions():  # the session deals to more: they stay empty
            rows = rows.union(rows.context.parallelize([], more))
        return rows.zip(placed).map(checked)


def without(docs: DataFrame, mark: Column, dropped: DataFrame, sizes: DataFrame) -> DataFrame:
    """The documents but those at the dropped places (part, place, mark), with all their columns, unmoved."""
    width = len(docs.columns)
    # Numbered names, as a document's own columns may have any.
    renamed = [docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns)]
    scan = Scan(docs.select(*renamed, mark.alias("mark")))
    left = scan.attach(dropped.withColumn("drop", F.lit(True)), sizes).filter(lambda pair: pair[1] is None)
    return docs.sparkSession.createDataFrame(left.map(lambda pair: pair[0][:width]), docs.schema, verifySchema=False)


def partition_sizes(places: DataFrame) -> DataFrame:
    return places.groupBy("part").agg(F.count("*").alias("n"))
