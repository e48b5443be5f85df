"""Order-free checksums of whole tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import hash_slice, row_text, slice_sum
from tidemark.operators.revisions import append_union

EXCLUDED = ("published_at",)
SLICES = 5
ROW_DIGEST = "_row_digest"

_SUM = T.DecimalType(38, 0)


def checksum_columns(df: DataFrame, exclude: Sequence[str] = EXCLUDED) -> list[str]:
    return sorted(name for name in df.columns if name not in exclude)


def _row_numbers(df: DataFrame, columns: Sequence[str], method: str) -> list[Column]:
    """Exact numbers that stand for a row: all slices of its digest, or one fast hash."""
    if method == "sha256":
        digest = F.sha2(row_text(df, columns), 256)
        return [hash_slice(digest, i) for i in range(SLICES)]
    if method == "xxhash64":
        # NULLs leave this hash unchanged, so the NULL pattern is hashed along with the values.
        flags = [F.col(f"`{name}`").isNull() for name in columns]
        return [F.xxhash64(*[F.col(f"`{name}`") for name in columns], *flags).cast(_SUM)]
    raise ValueError(f"unknown checksum method: {method}")


def table_checksum(
    df: DataFrame, exclude: Sequence[str] = EXCLUDED, method: str = "sha256"
) -> DataFrame:
    """One row with the row count and the sums of all slices of the row hashes, as text.

    Equal for equal multisets of rows whatever their order or partitioning. It is a partial sum
    per task and one small merge, so it scales with the scan alone.
    """
    numbers = _row_numbers(df, checksum_columns(df, exclude), method)
    named = df.select(*[number.alias(f"_{i}") for i, number in enumerate(numbers)])
    sums = [F.coalesce(F.sum(f"_{i}"), F.lit(0)).cast(_SUM).cast("string") for i in range(len(numbers))]
    return named.agg(F.count(F.lit(1)).alias("row_count"), F.concat_ws("-", *sums).alias("checksum"))


def row_digest(df: DataFrame, columns: Sequence[str]) -> Column:
    """The SHA-256 of each row's text over some columns."""
    return F.sha2(row_text(df, sorted(columns)), 256)


def with_row_digest(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """The table with the SHA-256 of each row, computed once for all sums over it."""
    return df.withColumn(ROW_DIGEST, row_digest(df, checksum_columns(df, exclude)))


def digest_sums() -> list[Column]:
    """Aggregates whose values identify the multiset of rows: a count and the sums of all slices."""
    return [F.count(F.lit(1)).alias("row_count"), *[slice_sum(ROW_DIGEST, i).alias(f"digest_{i}") for i in range(SLICES)]]


def table_digests(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One digest row per table."""
    return append_union(
        [
            with_row_digest(df).agg(*digest_sums()).select(F.lit(name).alias("table_name"), "*")
            for name, df in sorted(tables.items())
        ]
    )


def compare_tables(
    left: Mapping[str, DataFrame], right: Mapping[str, DataFrame], exclude: Sequence[str] = EXCLUDED
) -> DataFrame:
    """Counts and checksums of two copies of each table and whether they match."""
    sides = [
        table_checksum(df, exclude).select(F.lit(name).alias("table_name"), F.lit(side).alias("side"), "*")
        for side, tables in (("left", left), ("right", right))
        for name, df in sorted(tables.items())
    ]
    values = [
        F.max(F.when(F.col("side") == side, F.col(column))).alias(f"{side}_{label}")
        for side in ("left", "right")
        for column, label in (("row_count", "rows"), ("checksum", "checksum"))
    ]
    same = (F.col("left_rows").eqNullSafe(F.col("right_rows"))) & (
        F.col("left_checksum").eqNullSafe(F.col("right_checksum"))
    )
    return append_union(sides).groupBy("table_name").agg(*values).withColumn("matches", same)


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table."""
    return append_union(
        [
            df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
            for name, df in sorted(tables.items())
        ]
    )
