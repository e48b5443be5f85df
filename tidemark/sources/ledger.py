"""Append-only control ledgers kept as small Parquet tables."""

from __future__ import annotations

import time
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T

from tidemark.operators.revisions import newest_per_key
from tidemark.schemas import LEDGERS
from tidemark.sources import storage

_SEQUENCE = T.StructField("recorded_ns", T.LongType(), False)


def utc_now() -> datetime:
    return datetime.now(UTC)


class Ledger:
    """One ledger. Entries are never changed: a new state is a new entry, the newest one counts.

    A single writer appends; readers may be many.
    """

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark = spark
        self.path = f"{root}/control/{name}"
        self.columns = LEDGERS[name].names
        self.schema = T.StructType([*LEDGERS[name].fields, _SEQUENCE])

    def append(self, *entries: dict[str, object]) -> None:
        stamped = [tuple(entry.get(name) for name in self.columns) + (time.time_ns(),) for entry in entries]
        rows = self.spark.createDataFrame(stamped, self.schema)
        rows.coalesce(1).write.mode("append").parquet(self.path)

    def entries(self) -> DataFrame:
        if not storage.exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def latest(self, *key: str) -> DataFrame:
        """The newest entry per key."""
        return newest_per_key(self.entries(), key, ("recorded_ns",))

    def find(self, **key: str) -> Row | None:
        """The newest entry of one key, or None."""
        entries = self.entries()
        for name, value in key.items():
            entries = entries.where(entries[name] == value)
        found = entries.orderBy(entries.recorded_ns.desc()).limit(1).collect()
        return found[0] if found else None
