"""Paged JSON sources: envelopes with a list of records and a cursor."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import parse_timestamp
from tidemark.sources.windows import moment


def envelope(record: T.StructType, data_path: str = "items") -> T.StructType:
    return T.StructType(
        [T.StructField(data_path, T.ArrayType(record)), T.StructField("next_cursor", T.StringType())]
    )


def read_pages(spark: SparkSession, path: str, record: T.StructType, data_path: str = "items") -> DataFrame:
    """Landed pages, one envelope per file or line. A page that is not JSON fails the read."""
    return spark.read.schema(envelope(record, data_path)).option("mode", "FAILFAST").json(path)


def parse_pages(texts: DataFrame, column: str, record: T.StructType, data_path: str = "items") -> DataFrame:
    """Envelopes held as text."""
    page = F.from_json(F.col(column), envelope(record, data_path), {"mode": "FAILFAST"})
    return texts.select(page.alias("page")).select("page.*")


def page_items(
    pages: DataFrame,
    data_path: str = "items",
    updated_at: str = "updated_at",
    window: tuple[datetime, datetime] | None = None,
) -> DataFrame:
    """The records of all pages. A window keeps ``[start, end)`` and drops records without a time."""
    rows = pages.select(F.explode(data_path).alias("item")).select("item.*")
    if window is None:
        return rows
    at = parse_timestamp(updated_at)
    return rows.where((at >= moment(window[0])) & (at < moment(window[1])))


def page_watermark(items: DataFrame, updated_at: str = "updated_at") -> DataFrame:
    """The newest time among the records, compared as timestamps rather than as text."""
    return items.agg(F.max(parse_timestamp(updated_at)).alias("updated_at"))
