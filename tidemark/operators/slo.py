"""Service-level reports over the control ledgers.

``as_of`` is always a parameter, so a report can be repeated.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import age_seconds
from tidemark.operators.revisions import append_union, key_set

BATCH_PROBLEMS = ("LOADING", "FAILED", "QUARANTINED")
RUN_PROBLEMS = ("RUNNING", "FAILED")
RELEASE_PROBLEMS = ("PREPARING", "PARTIAL", "FAILED")

# Fixed alert thresholds in seconds, by metric.
THRESHOLDS = {
    "batch_problem_age": 1800.0,
    "run_problem_age": 1800.0,
    "release_problem_age": 900.0,
    "checkpoint_age": 93600.0,
    "publication_age": 93600.0,
}


def _count_and_age(df: DataFrame, by: list[str], age: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("problems"), F.max(age).alias("max_age_seconds"))


def problem_batches(manifest: DataFrame, as_of: Column) -> DataFrame:
    stuck = manifest.where(F.col("status").isin(*BATCH_PROBLEMS))
    return _count_and_age(stuck, ["source", "status"], age_seconds(as_of, "updated_at"))


def problem_runs(runs: DataFrame, as_of: Column) -> DataFrame:
    """Runs of the last 24 hours that failed or still run."""
    recent = runs.where(
        (F.col("started_at") > as_of - F.expr("INTERVAL 24 HOURS")) & F.col("status").isin(*RUN_PROBLEMS)
    ).withColumn("source", F.coalesce("source", F.lit("")))
    age = age_seconds(as_of, F.coalesce("finished_at", "started_at"))
    return _count_and_age(recent, ["run_type", "status", "source"], age)


def checkpoint_ages(checkpoints: DataFrame, as_of: Column) -> DataFrame:
    return checkpoints.select("source", age_seconds(as_of, "updated_at").alias("age_seconds"))


def publication_ages(publications: DataFrame, as_of: Column) -> DataFrame:
    committed = publications.where(F.col("status") == "COMMITTED")
    newest = committed.groupBy("dataset").agg(F.max("committed_at").alias("newest"))
    return newest.select("dataset", age_seconds(as_of, "newest").alias("age_seconds"))


def release_problems(releases: DataFrame, as_of: Column) -> DataFrame:
    open_releases = releases.where(F.col("status").isin(*RELEASE_PROBLEMS))
    return _count_and_age(open_releases, ["status"], age_seconds(as_of, "created_at"))


def released_runs(runs: DataFrame, publications: DataFrame) -> DataFrame:
    """Runs that published at least one dataset."""
    return runs.join(key_set(publications, "run_id"), "run_id", "left_semi")


def slo_breaches(ledgers: Mapping[str, DataFrame], as_of: Column) -> DataFrame:
    """Every report value above its threshold, with what it concerns."""

    def metric(name: str, df: DataFrame, subject: Column, value: str) -> DataFrame:
        return df.select(F.lit(name).alias("metric"), subject.alias("subject"), F.col(value).alias("value"))

    values = append_union(
        [
            metric(
                "batch_problem_age",
                problem_batches(ledgers["batch_manifest"], as_of),
                F.concat_ws("/", "source", "status"),
                "max_age_seconds",
            ),
            metric(
                "run_problem_age",
                problem_runs(ledgers["pipeline_run"], as_of),
                F.concat_ws("/", "run_type", "status", "source"),
                "max_age_seconds",
            ),
            metric("release_problem_age", release_problems(ledgers["dataset_release"], as_of), F.col("status"),
                   "max_age_seconds"),
            metric("checkpoint_age", checkpoint_ages(ledgers["source_checkpoint"], as_of), F.col("source"),
                   "age_seconds"),
            metric("publication_age", publication_ages(ledgers["publication_manifest"], as_of), F.col("dataset"),
                   "age_seconds"),
        ]
    )
    limits = F.create_map(*[F.lit(part) for pair in THRESHOLDS.items() for part in pair])
    limited = values.withColumn("threshold", limits[F.col("metric")])
    return limited.where(F.col("value") > F.col("threshold"))
