"""Closed months of raw tables rewritten into few files sorted by key; batches stay as a column."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.checksums import digest_sums, with_row_digest
from tidemark.schemas import RAW_TABLES
from tidemark.sources import storage
from tidemark.sources.ledger import Ledger, utc_now
from tidemark.sources.raw import MONTH, raw_path, raw_schema
from tidemark.sources.staged import loaded_batches, read_loaded

TARGET_BYTES = 512 << 20
_RANGES = "file string, low string, high string, row_count long"


def _entries(spark: SparkSession, root: str, table: str) -> list:
    """The newest rewrite of each month; one row a month."""
    latest = Ledger(spark, root, "compaction").latest("table_name", "month")
    return latest.where(F.col("table_name") == table).orderBy("month").collect()


def _written(spark: SparkSession, table: str, path: str) -> DataFrame:
    month = T.StructField(MONTH, T.StringType(), False)
    fields = [f for f in raw_schema(table).fields if f.name != MONTH]
    return spark.read.schema(T.StructType([*fields, month])).parquet(f"{path}/rows")


def _covered(entries: list) -> Column:
    """Rows of the raw folders that a rewrite holds: literal conditions on month and batch."""
    covered = F.lit(False)
    for entry in entries:
        covered = covered | ((F.col(MONTH) == entry.month) & F.col("batch_id").isin(json.loads(entry.batches)))
    return covered


def read_compacted(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The loaded rows of a raw table: rewritten months, and the batches that came since."""
    entries = _entries(spark, root, table)
    rows = read_loaded(spark, root, table).where(~_covered(entries))
    for entry in entries:
        rows = rows.unionByName(_written(spark, table, entry.path))
    return rows


def _digest(df: DataFrame) -> tuple:
    return tuple(with_row_digest(df).agg(*digest_sums()).first())


def compact_month(spark: SparkSession, root: str, table: str, month: str, target_bytes: int = TARGET_BYTES) -> str:
    """Rewrite one closed month: as many files as its bytes fill, each a key range, sorted by key and time.

    What an earlier rewrite holds is taken along. The new files count once the ledger names them, which
    it does after their content digest equals that of the rows they replace; a rewrite that died before
    is files that nobody reads. Returns the path of the rewrite.
    """
    contract = RAW_TABLES[table]
    before = read_compacted(spark, root, table).where(F.col(MONTH) == month)
    batches = sorted(set(loaded_batches(spark, root)))
    size = sum(storage.size(spark, found) for found in storage.matching(spark, f"{raw_path(root, table)}/{MONTH}={month}/batch_id=*")
               if found.rpartition("batch_id=")[2] in set(batches))
    size += sum(storage.size(spark, entry.path) for entry in _entries(spark, root, table) if entry.month == month)
    path = f"{root}/compact/{table}/{month}/{uuid.uuid4().hex}"
    files = max(1, -(-size // target_bytes))
    order = [contract.key, "source_updated_at", "batch_id", "record_hash"]
    before.repartitionByRange(files, *order).sortWithinPartitions(*order).write.parquet(f"{path}/rows")
    after = _written(spark, table, path)
    expected, found = _digest(before), _digest(after)
    if expected != found:
        raise RuntimeError(f"the rewrite of {table} {month} differs from its rows: {found[0]}/{expected[0]}")
    key = F.col(contract.key)
    after.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("row_count")).coalesce(1).write.parquet(f"{path}/ranges")
    Ledger(spark, root, "compaction").append({"table_name": table, "month": month, "path": path, "batches": json.dumps(batches),
                                              "row_count": found[0], "updated_at": utc_now()})
    return path


def key_files(spark: SparkSession, root: str, table: str, key: str) -> list[str]:
    """The rewritten files whose key range holds a key."""
    entries = _entries(spark, root, table)
    if not entries:
        return []
    ranges = spark.read.schema(_RANGES).parquet(*[f"{entry.path}/ranges" for entry in entries])
    return sorted(row.file for row in ranges.where(F.lit(key).between(F.col("low"), F.col("high"))).collect())


def lookup(spark: SparkSession, root: str, table: str, key: str) -> DataFrame:
    """All loaded revisions of one key. Of rewritten months only the files whose range holds it are opened."""
    rows = read_loaded(spark, root, table).where(~_covered(_entries(spark, root, table)))
    files = key_files(spark, root, table, key)
    if files:
        month = T.StructField(MONTH, T.StringType(), False)
        schema = T.StructType([*[f for f in raw_schema(table).fields if f.name != MONTH], month])
        rows = rows.unionByName(spark.read.schema(schema).parquet(*files))
    return rows.where(F.col(RAW_TABLES[table].key) == key)


def drop_replaced(spark: SparkSession, root: str, table: str) -> int:
    """Remove the folders that rewrites replaced; to be run when no reader is on them."""
    removed = 0
    for entry in _entries(spark, root, table):
        batches = set(json.loads(entry.batches))
        for found in storage.matching(spark, f"{raw_path(root, table)}/{MONTH}={entry.month}/batch_id=*"):
            if found.rpartition("batch_id=")[2] in batches:
                storage.remove(spark, found)
                removed += 1
        for found in storage.matching(spark, f"{root}/compact/{table}/{entry.month}/*"):
            if not found.endswith(entry.path.rpartition("/")[2]):
                storage.remove(spark, found)
                removed += 1
    return removed
