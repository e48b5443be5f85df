"""File system calls through Spark's own Hadoop layer, so any store Spark reaches will do."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Hashes are most of the bytes of a raw row; this codec halves their hex digits, the default one keeps them.
CODEC = "zstd"


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, files = _path(spark, path)
    return files.exists(target)


def as_uri(spark: SparkSession, path: str) -> str:
    """The path part of a folder's address as file listings write it, ending in a slash; scheme and host are left out."""
    return _path(spark, path)[0].toUri().getRawPath().rstrip("/") + "/"


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a directory; the target must not exist."""
    origin, files = _path(spark, source)
    goal, _ = _path(spark, target)
    files.mkdirs(goal.getParent())
    if files.exists(goal) or not files.rename(origin, goal):
        raise RuntimeError(f"cannot move {source} to {target}")


def remove(spark: SparkSession, path: str) -> None:
    target, files = _path(spark, path)
    files.delete(target, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a directory; none when it does not exist."""
    target, files = _path(spark, path)
    return sorted(entry.getPath().getName() for entry in files.listStatus(target)) if files.exists(target) else []


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match a pattern with ``*``."""
    target, files = _path(spark, pattern)
    return sorted(str(entry.getPath()) for entry in files.globStatus(target) or [])


def size(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path."""
    target, files = _path(spark, path)
    return files.getContentSummary(target).getLength()
