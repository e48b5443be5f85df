"""Operators over append-only revision logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import packed_digest, unpacked_digest

# The order of revisions, newest by these columns. Every operator uses the first one unless told
# otherwise, so staging and hard-delete detection cannot disagree about ties.
SOURCE_ORDER = ("source_updated_at", "batch_id", "record_hash")
LOAD_ORDER = ("source_updated_at", "ingested_at", "record_hash")

_RANK = "_revision_rank"
_HASH = "record_hash"


def _names(columns: str | Sequence[str]) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def _packs(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> bool:
    return _HASH in order and _HASH not in key and isinstance(df.schema[_HASH].dataType, T.StringType)


def key_set(df: DataFrame, key: str) -> DataFrame:
    """The distinct keys of one side of a semi or anti join.

    Repeats are removed before the shuffle, so a key that fills the side arrives once per input
    task; the shuffle itself is the one the join needs anyway.
    """
    return df.select(key).distinct()


def newest_per_key(
    df: DataFrame, key: str | Sequence[str], order: Sequence[str] = SOURCE_ORDER, keep: int = 1
) -> DataFrame:
    """The ``keep`` newest rows per key.

    The rank filter sits directly on the window, so Spark limits every group before the shuffle
    as well as after it: a key with a third of all rows sends at most ``keep`` rows per input
    task. ``order`` has to be total within a key for the result to be repeatable. The record hash is
    most of the bytes of a row, so it is sorted and shuffled packed.
    """
    packs = _packs(df, _names(key), order)
    rows = df.withColumn(_HASH, packed_digest(_HASH)) if packs else df
    window = Window.partitionBy(*_names(key)).orderBy(*[F.col(name).desc() for name in order])
    newest = rows.withColumn(_RANK, F.row_number().over(window)).where(F.col(_RANK) <= keep).drop(_RANK)
    return newest.withColumn(_HASH, unpacked_digest(_HASH)) if packs else newest


def latest_live(df: DataFrame, key: str | Sequence[str], order: Sequence[str] = SOURCE_ORDER) -> DataFrame:
    """Newest revision per key, without the keys whose newest revision is a tombstone.

    Deletes are dropped after ranking: dropping them first would bring back older revisions.
    """
    return newest_per_key(df, key, order).where(~F.col("is_deleted"))


def live_keys(df: DataFrame, key: str, order: Sequence[str] = SOURCE_ORDER) -> DataFrame:
    """Keys whose newest flag is not deleted, found by aggregation instead of ranking."""
    packs = _packs(df, [key], order)
    newest_flag = F.max_by("is_deleted", F.struct(*[packed_digest(n) if packs and n == _HASH else F.col(n) for n in order]))
    return df.groupBy(key).agg(newest_flag.alias("_deleted")).where(~F.col("_deleted")).select(key)


def hard_delete_keys(raw: DataFrame, source_keys: DataFrame, key: str, order: Sequence[str] = SOURCE_ORDER) -> DataFrame:
    """Keys that are live in the log but gone from the source."""
    return live_keys(raw, key, order).join(key_set(source_keys, key), key, "left_anti")


def tombstones(
    raw: DataFrame,
    source_keys: DataFrame,
    key: str,
    business: Sequence[str],
    now: Column,
    order: Sequence[str] = SOURCE_ORDER,
) -> DataFrame:
    """The newest business row of every hard-deleted key, flagged deleted as of ``now``.

    Ranking, the live test and the anti join all run on ``key``, so one shuffle of the log serves
    every key at once.
    """
    gone = latest_live(raw, key, order).join(key_set(source_keys, key), key, "left_anti")
    marked = gone.withColumns({"is_deleted": F.lit(True), "updated_at": now})
    return marked.select(*business)


def latest_rows_for_keys(
    raw: DataFrame, keys: DataFrame, key: str, business: Sequence[str], order: Sequence[str] = SOURCE_ORDER
) -> DataFrame:
    """Newest full row, deleted or not, of the given keys. ``keys`` may repeat a key."""
    return newest_per_key(raw, key, order).join(key_set(keys, key), key, "left_semi").select(*business)


def upsert_latest(target: DataFrame, changes: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``target`` with ``changes`` applied per key: a change replaces the row it meets.

    When several changes meet in one call, the newest by ``order`` wins.
    """
    both = target.withColumn("_incoming", F.lit(0)).unionByName(changes.withColumn("_incoming", F.lit(1)))
    return newest_per_key(both, key, ("_incoming", *order)).drop("_incoming")


def insert_if_absent(target: DataFrame, new: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The rows of ``new`` to append: one per key, and only keys the target does not hold."""
    return newest_per_key(new, key, order).join(key_set(target, key), key, "left_anti")


def append_union(batches: Sequence[DataFrame]) -> DataFrame:
    """A raw table as the union of its batches."""
    first, *rest = batches
    for batch in rest:
        first = first.unionByName(batch)
    return first


def missing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Set difference of two key sets."""
    return left.select(key).subtract(right.select(key))


def beyond_newest(df: DataFrame, group: str, name: str, order: Sequence[str], keep: int = 3) -> DataFrame:
    """Rows of each group that are not among its ``keep`` newest.

    The kept rows are few per group, so they are found with the pre-shuffle limit and taken away
    by an anti join on the unique ``name``; ranking the whole of a large group in one task is
    never needed.
    """
    kept = newest_per_key(df.select(group, name, *[c for c in order if c not in (group, name)]), group, order, keep)
    return df.join(kept.select(name), name, "left_anti")
