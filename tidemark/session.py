"""Session settings and the shared folder every job writes to."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Result = TypeVar("Result")

# A task ranks all rows of its split before the shuffle. Parquet rows take fifteen times their bytes and more in
# memory, so the rows of Spark's own 128 MB do not fit into a task's share of it and are spilled; these do.
SPLIT_BYTES = 16 << 20
# No split cuts a row group, which may hold any number of rows; a task takes no more than about so many of them.
SPLIT_ROWS = 1 << 20
_SLICE_BITS = 12
_SPLIT = "spark.sql.files.maxPartitionBytes"


def build_session(name: str = "tidemark", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings the operators rely on; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        _SPLIT: str(SPLIT_BYTES),
    } | {key.replace("__", "."): str(value) for key, value in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def limit_splits(spark: SparkSession) -> None:
    """Read files in splits whose rows fit into a task's memory. A smaller size that was set stays."""
    as_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if as_bytes(spark.conf.get(_SPLIT)) > SPLIT_BYTES:
        spark.conf.set(_SPLIT, str(SPLIT_BYTES))


def limit_rows(df: DataFrame) -> DataFrame:
    """A table just read from files, with no more than about ``SPLIT_ROWS`` rows to a task.

    Rows are counted per split first, which reads no column. Only when a row group holds more are its rows dealt
    over several tasks, by their place in the file: each reads the columns it needs again and keeps its own rows.
    """
    longest = df.groupBy(F.spark_partition_id().alias("split")).count().agg(F.max("count")).first()[0] or 0
    tasks = -(-longest // SPLIT_ROWS)
    if tasks <= 1:
        return df
    place = F.pmod(F.shiftright("_metadata.row_index", _SLICE_BITS), F.lit(tasks))
    first, *others = [df.where(place == task) for task in range(tasks)]
    for other in others:
        first = first.union(other)
    return first


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, taken from the session.

    Only a local session may fall back to a folder of its own; on a cluster a machine-local
    folder would lose data with the machine, so an unset folder is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="tidemark-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir() or folder


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A folder of its own for one run below the shared folder."""
    return f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def together(spark: SparkSession, *jobs: Callable[[], Result]) -> list[Result]:
    """Run a few independent Spark jobs at once, so the tail of one does not idle the cluster.

    Results come in the order of the jobs; the first error is raised after all have ended.
    """
    with ThreadPoolExecutor(max_workers=max(1, len(jobs))) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
    return [job.result() for job in running]
