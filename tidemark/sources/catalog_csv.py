"""The product catalog CSV and its contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import parse_money, parse_timestamp, truthy
from tidemark.operators.checksums import digest_sums, with_row_digest

# Fixed column names of the file; is_deleted may be left out.
REQUIRED = ("product_id", "product_name", "category", "unit_cost", "updated_at")


def read_text_columns(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """All columns as text, named by the header, with the file they came from.

    Quoted line breaks need ``multi_line``, which reads each file in one task; files without them
    can be split by turning it off. Every file has to carry the first file's header.
    """
    options = {"header": True, "multiLine": multi_line, "escape": '"', "inferSchema": False}
    header = spark.read.options(**options).csv(path).schema
    missing = sorted(set(REQUIRED) - set(header.names))
    if missing:
        raise ValueError(f"catalog contract: missing columns {', '.join(missing)}")
    rows = spark.read.schema(header).options(enforceSchema=False, **options).csv(path)
    return rows.select("*", F.col("_metadata.file_path").alias("file_path"))


def problem(df: DataFrame) -> Column:
    """What is wrong with a row, or NULL."""
    bad_cost = (F.coalesce(F.col("unit_cost"), F.lit("")) != "") & parse_money("unit_cost").isNull()
    bad_time = parse_timestamp("updated_at").isNull()
    return F.when(bad_cost, F.lit("unit_cost is not numeric")).when(bad_time, F.lit("updated_at is not a timestamp"))


def catalog_violations(df: DataFrame) -> DataFrame:
    """The rows that break the contract, each with its reason and raw values."""
    checked = df.withColumn("problem", problem(df)).where(F.col("problem").isNotNull())
    extra = ["file_path"] if "file_path" in df.columns else []
    return checked.select(*extra, "product_id", "unit_cost", "updated_at", "problem")


def catalog_rows(df: DataFrame) -> DataFrame:
    """Typed catalog rows. One bad row fails the job, so a file is taken whole or not at all."""
    reason = problem(df)
    deleted = truthy("is_deleted") if "is_deleted" in df.columns else F.lit(False)
    where = F.col("file_path") if "file_path" in df.columns else F.lit("input")
    fail = F.raise_error(F.concat_ws(" ", F.lit("catalog contract:"), where, F.col("product_id"), reason))
    # The check is a filter, not a column, so that no column pruning can take it away.
    sound = df.where(F.when(reason.isNotNull(), fail.cast("boolean")).otherwise(F.lit(True)))
    return sound.select(
        "product_id",
        F.coalesce("product_name", F.lit("")).alias("product_name"),
        F.coalesce("category", F.lit("")).alias("category"),
        parse_money(F.nullif(F.col("unit_cost"), F.lit(""))).alias("unit_cost"),
        parse_timestamp("updated_at").alias("updated_at"),
        deleted.alias("is_deleted"),
    )


def read_catalog(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return catalog_rows(read_text_columns(spark, path, multi_line))


def fingerprint(rows: DataFrame) -> DataFrame:
    """A fingerprint of the parsed records of a text source, built from the SHA-256 of each.

    Records, not lines, are hashed, so text that moves from one record to another is a change. It is a
    sum over tasks and does not depend on the order of records or files.
    """
    sums = with_row_digest(rows).agg(*digest_sums())
    return sums.select(F.sha2(F.concat_ws(":", *[F.col(name).cast("string") for name in sums.columns]), 256).alias("fingerprint"))


def text_fingerprint(spark: SparkSession, path: str, multi_line: bool = True) -> str:
    return fingerprint(read_text_columns(spark, path, multi_line).drop("file_path")).first()[0]


def changed_since(fingerprint: str, checkpoint: dict[str, object] | None) -> bool:
    """Whether a file has to be read again."""
    return not checkpoint or checkpoint.get("sha256") != fingerprint
