"""Incremental and bounded extracts."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import UTC, date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.revisions import append_union
from tidemark.schemas import RAW_TABLES

EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
LOOKBACK = timedelta(hours=2)
EVENTS_LOOKBACK = timedelta(hours=48)


def moment(value: datetime) -> Column:
    """A timestamp literal that does not depend on the zone of the machine."""
    return F.timestamp_micros(F.lit(int((value.astimezone(UTC) - EPOCH) / timedelta(microseconds=1))))


def lower_bound(watermark: datetime | None, table: str) -> datetime:
    """Where an incremental extract starts: the watermark less the table's lookback."""
    if watermark is None:
        base = EPOCH
        return base - (EVENTS_LOOKBACK - LOOKBACK) if table == "events" else base
    return watermark - (EVENTS_LOOKBACK if table == "events" else LOOKBACK)


def day_window(start: date, end: date) -> tuple[datetime, datetime]:
    """Both days included, as a half-open pair of UTC midnights."""
    first = datetime.combine(start, time.min, tzinfo=UTC)
    return first, datetime.combine(end + timedelta(days=1), time.min, tzinfo=UTC)


def since(df: DataFrame, cursor: str, lower: datetime) -> DataFrame:
    return df.where(F.col(cursor) >= moment(lower))


def within(df: DataFrame, cursor: str, window: tuple[datetime, datetime]) -> DataFrame:
    return df.where((F.col(cursor) >= moment(window[0])) & (F.col(cursor) < moment(window[1])))


def in_extract_order(df: DataFrame, table: str) -> DataFrame:
    """Rows by cursor, then key; for a consumer that needs the order, as it costs a range shuffle."""
    contract = RAW_TABLES[table]
    return df.orderBy(contract.cursor, contract.key)


def extract(
    tables: Mapping[str, DataFrame],
    watermark: datetime | None = None,
    window: tuple[datetime, datetime] | None = None,
    cursors: Mapping[str, str] | None = None,
) -> dict[str, DataFrame]:
    """Every table's rows since the watermark, or inside the window when one is given.

    The bounds are plain comparisons with literals on the cursor column, so they reach the scan. A
    table's cursor is the one named in ``cursors``, else its contract's, else ``updated_at``.
    """
    named = {name: contract.cursor for name, contract in RAW_TABLES.items()} | dict(cursors or {})
    out = {}
    for name, df in tables.items():
        cursor = named.get(name, "updated_at")
        out[name] = within(df, cursor, window) if window else since(df, cursor, lower_bound(watermark, name))
    return out


def source_watermark(tables: Iterable[DataFrame]) -> DataFrame:
    """The greatest ``updated_at`` over all tables of a source."""
    highs = [df.agg(F.max("updated_at").alias("updated_at")) for df in tables]
    return append_union(highs).agg(F.max("updated_at").alias("updated_at"))


def cursor_predicates(cursor: str, lower: datetime, upper: datetime, slices: int) -> list[str]:
    """Half-open conditions that cut ``[lower, upper)`` into equal spans, one per read task.

    The last span is open to the right, so rows newer than ``upper`` are not lost.
    """
    step = (upper - lower) / slices
    edges = [lower + step * i for i in range(slices)]
    stamps = [f"TIMESTAMP WITH TIME ZONE '{edge.astimezone(UTC):%Y-%m-%d %H:%M:%S.%f}+00:00'" for edge in edges]
    spans = [f"{cursor} >= {a} AND {cursor} < {b}" for a, b in zip(stamps, stamps[1:])]
    return [*spans, f"{cursor} >= {stamps[-1]}"]


def read_jdbc(
    spark: SparkSession, url: str, table: str, lower: datetime, upper: datetime, slices: int, properties: dict[str, str]
) -> DataFrame:
    """Incremental read of a database table in parallel slices of its cursor."""
    predicates = cursor_predicates(RAW_TABLES[table].cursor, lower, upper, slices)
    return spark.read.jdbc(url, table, predicates=predicates, properties=properties)
