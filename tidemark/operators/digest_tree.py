"""Where two copies of a table differ, found by digests of key ranges before any rows are compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.checksums import SLICES, digest_sums, with_row_digest
from tidemark.operators.revisions import append_union
from tidemark.session import work_dir

DEPTH = 3
_SUMS = ["row_count", *[f"digest_{i}" for i in range(SLICES)]]


def prefix(key: str, depth: int) -> Column:
    """The first hex digits of a key's hash."""
    return F.substring(F.lpad(F.hex(F.xxhash64(key)), 16, "0"), 1, depth)


def digest_tree(df: DataFrame, key: str, depth: int = DEPTH) -> DataFrame:
    """Counts and digest sums of all rows by key-hash prefix, at every level from the root to ``depth``.

    The table is read once, with partial sums per task; the sums of the lowest level are then added up
    for every level above. A tree has 16^depth rows at its lowest level, whatever the table's size, and
    may be stored.
    """
    lowest = with_row_digest(df).withColumn("prefix", prefix(key, depth)).groupBy("prefix").agg(*digest_sums())
    every = lowest.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    every = every.withColumn("prefix", F.substring(F.col("prefix"), F.lit(1), F.col("level")))
    sums = [F.sum(name).cast(lowest.schema[name].dataType).alias(name) for name in _SUMS]
    return every.groupBy("level", "prefix").agg(*sums)


def differing_prefixes(left: DataFrame, right: DataFrame, depth: int = DEPTH) -> list[str]:
    """The prefixes of the lowest level under which two (stored) trees differ; 16^depth at most.

    The walk starts at the root and reads the children of differing nodes only, by a literal filter,
    so a tree of an equal copy is read at one row.
    """
    found = [""]
    for level in range(depth + 1):
        parent = F.substring("prefix", 1, max(level - 1, 0))
        sides = [
            tree.where((F.col("level") == level) & parent.isin(found)).select("prefix", F.struct(*_SUMS).alias(side))
            for tree, side in ((left, "left"), (right, "right"))
        ]
        both = sides[0].join(sides[1], "prefix", "full").where(~F.col("left").eqNullSafe(F.col("right")))
        found = sorted(row.prefix for row in both.select("prefix").collect())
        if not found:
            break
    return found


def differing_rows(left: DataFrame, right: DataFrame, key: str, depth: int = DEPTH) -> DataFrame:
    """The rows of all keys that the two tables do not share equally, marked ``left`` or ``right``.

    A key whose rows differ shows its rows of both sides; an inserted or deleted one shows one side.
    Rows are compared as multisets per key, and only under prefixes whose digests differ. The columns
    are those of ``left``, which ``right`` must have.
    """
    right = right.select(*left.columns)
    spark, folder = left.sparkSession, work_dir(left.sparkSession, "digest-tree")
    trees = []
    for side, df in (("left", left), ("right", right)):
        digest_tree(df, key, depth).write.parquet(f"{folder}/{side}")
        trees.append(spark.read.parquet(f"{folder}/{side}"))
    prefixes = differing_prefixes(*trees, depth)

    def under(df: DataFrame) -> DataFrame:
        return df.where(prefix(key, depth).isin(prefixes))

    def per_key(df: DataFrame, side: str) -> DataFrame:
        sums = with_row_digest(under(df)).groupBy(F.col(key).alias("_key")).agg(*digest_sums())
        return sums.select("_key", F.struct(*_SUMS).alias(side))

    a, b = per_key(left, "left"), per_key(right, "right").withColumnRenamed("_key", "_other")
    both = a.join(b, F.col("_key").eqNullSafe(F.col("_other")), "full").where(~F.col("left").eqNullSafe(F.col("right")))
    keys = both.select(F.when(F.col("left").isNull(), F.col("_other")).otherwise(F.col("_key")).alias("_key"))
    return append_union([
        under(df).join(keys, F.col(key).eqNullSafe(F.col("_key")), "left_semi").select(F.lit(side).alias("side"), "*")
        for df, side in ((left, "left"), (right, "right"))
    ])
