"""Streaming twins of the incremental landing, exact under replay.

All of them run with an available-now trigger: they take what has arrived since the last run and
stop. Output folders are written per micro-batch, so a batch that is replayed after a failure
replaces its own output and nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import row_text, utc_day
from tidemark.operators.revisions import latest_live
from tidemark.plans.commerce import FUNNEL_COUNTS, campaign_event_metrics
from tidemark.sources import storage

BATCH = "stream_batch"
DAY = "event_date"
REDELIVERY = "48 hours"


def _run(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, str], None]) -> None:
    """Take what has arrived. ``each`` gets a micro-batch and its name.

    The name is the same whenever the batch is replayed, and differs between checkpoints, whose
    batch numbers all start at zero.
    """
    origin = hashlib.sha256(checkpoint.encode()).hexdigest()
    query = (
        stream.writeStream.foreachBatch(lambda batch, number: each(batch, f"{origin}-{number:09d}"))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def land_revisions(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append a stream of revisions to a log, each micro-batch in a folder of its own.

    Nothing is dropped, however late; duplicates are settled on read by the ranking.
    """
    _run(stream, checkpoint, lambda batch, name: batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={name}"))


def drop_redelivered(stream: DataFrame, key: str, moment: str, delay: str = REDELIVERY) -> DataFrame:
    """First delivery per key, with state bounded by the redelivery window.

    Exact only while input is in time order to within ``delay``: Spark drops rows older than the
    watermark, and reports their number in the query's progress. Use ``land_first_deliveries``
    where that is not given.
    """
    return stream.withWatermark(moment, delay).dropDuplicatesWithinWatermark([key])


def _write_days(rows: DataFrame, name: str, path: str) -> None:
    tagged = rows.withColumn(BATCH, F.lit(name))
    writer = tagged.hint("rebalance", DAY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(DAY, BATCH).parquet(path)


def _days_of(rows: DataFrame) -> tuple[object, object] | None:
    """First and last day of a micro-batch: one small row, used to prune folders."""
    first, last = rows.agg(F.min(DAY), F.max(DAY)).first()
    return None if first is None else (first, last)


def _read(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    schema = like.drop(DAY).schema.add(DAY, "date").add(BATCH, "string")
    return spark.read.schema(schema).parquet(path)


def land_first_deliveries(stream: DataFrame, key: str, moment: str, path: str, checkpoint: str) -> None:
    """First delivery per key, exact for any arrival order.

    The table itself is the state: a micro-batch is matched with the days it touches. A key keeps
    its event time in every delivery, so all its deliveries meet in one day's folder; a key that comes
    with another event time is a fault of the source and is kept once per day. Across micro-batches
    the earlier one wins; within one, the smallest row in (event time, row digest), so a replay
    settles ties alike.
    """

    def each(batch: DataFrame, name: str) -> None:
        ranked = batch.withColumns({DAY: utc_day(moment), "_digest": F.sha2(row_text(batch, batch.columns), 256)})
        order = Window.partitionBy(key).orderBy(moment, "_digest")
        rows = ranked.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank", "_digest")
        days = _days_of(rows)
        if days is None:
            return
        spark = batch.sparkSession
        if storage.exists(spark, path):
            earlier = _read(spark, path, rows).where(F.col(DAY).between(*days) & (F.col(BATCH) != name))
            # The days that the batch touches, one row each: folders of other days are not read.
            touched = rows.select(DAY).distinct()
            earlier = earlier.select(key, DAY).join(F.broadcast(touched), DAY, "left_semi")
            rows = rows.join(earlier, [key, DAY], "left_anti")
        _write_days(rows, name, path)

    _run(stream, checkpoint, each)


def refresh_funnel_metrics(stream: DataFrame, log_path: str, metrics_path: str, checkpoint: str) -> None:
    """Daily campaign metrics kept up to date from a stream of event revisions.

    Each micro-batch is landed, then the days it touches are computed again from the whole log of
    those days and replace their old result, so late events and late deletes count. The event
    time of an event does not change between revisions.
    """

    def each(batch: DataFrame, name: str) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn(DAY, utc_day("occurred_at"))
        _write_days(rows, name, log_path)
        landed = _read(spark, log_path, rows)
        days = _days_of(landed.where(F.col(BATCH) == name))
        if days is None:
            return
        span = landed.where(F.col(DAY).between(*days))
        touched = span.where(F.col(BATCH) == name).select(DAY).distinct()
        # One row per calendar day at most, so the broadcast is bounded and a day that holds most
        # of the log is not sent to one task.
        history = span.join(F.broadcast(touched), DAY, "left_semi").drop(DAY, BATCH)
        metrics = campaign_event_metrics(latest_live(history, "event_id"))
        # A row without a campaign per touched day, so a day that lost all its events is replaced too.
        zeros = [F.lit(0).cast("long").alias(count) for count in FUNNEL_COUNTS]
        marks = touched.select(DAY, F.lit(None).cast("string").alias("campaign_id"), *zeros)
        writer = metrics.unionByName(marks).hint("rebalance", DAY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(DAY).parquet(metrics_path)

    _run(stream, checkpoint, each)


def read_funnel_metrics(spark: SparkSession, metrics_path: str) -> DataFrame:
    """The metrics kept by ``refresh_funnel_metrics``."""
    counts = [f"{name} bigint" for name in FUNNEL_COUNTS]
    schema = ", ".join(["campaign_id string", *counts, f"{DAY} date"])
    kept = spark.read.schema(schema).parquet(metrics_path).where(F.col("campaign_id").isNotNull())
    return kept.select(DAY, "campaign_id", *FUNNEL_COUNTS)
