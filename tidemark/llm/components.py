"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import work_dir


def _written(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return spark.read.parquet(path)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them (edges hold a > b)."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = edges.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return tied.union(low.select("a", F.col("m").alias("b"))).distinct()


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link; the root is the smallest node it reaches.

    ``links`` has the integer columns ``a`` and ``b`` in any order, repeated or not. Each step is
    written to the shared folder, so the plan stays short and a lost executor costs one step. A node
    that a third of all links share is summed before the shuffle, and its join is left to
    adaptive skew handling.
    """
    folder = work_dir(spark, "components")
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = _written(spark, edges, f"{folder}/0")
    state, step = None, 0
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == state or not mark[0]:
            break
        state, step = mark, step + 1
        edges = _written(spark, _small_star(_large_star(edges)), f"{folder}/{step}")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
