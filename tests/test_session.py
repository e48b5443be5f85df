import pytest
from pyspark.sql import functions as F

from tidemark import session
from tidemark.plans.views import Tables
from tidemark.session import SPLIT_BYTES

NAME = "spark.sql.files.maxPartitionBytes"


@pytest.mark.parametrize(("before", "parts"), [("128m", 3), ("1m", 30)])
def test_tables_are_read_in_splits_that_a_task_can_rank(spark, tmp_path, before, parts):
    """A split of 128 MB is spilled when its rows are ranked; a smaller size that was set stays."""
    kept = spark.conf.get(NAME)
    spark.range(5_000_000).coalesce(1).write.option("parquet.block.size", 1 << 20).option("compression", "none").parquet(f"{tmp_path}/numbers.parquet")
    try:
        spark.conf.set(NAME, before)
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        assert Tables(spark, str(tmp_path))["numbers"].rdd.getNumPartitions() >= parts
        assert int(spark.conf.get(NAME).rstrip("b")) == SPLIT_BYTES if before == "128m" else spark.conf.get(NAME) == before
    finally:
        spark.conf.set(NAME, kept)
        spark.conf.unset("spark.sql.files.minPartitionNum")


@pytest.mark.parametrize(("limit", "tasks"), [(50_000, 4), (200_000, 1)])
def test_rows_of_a_large_row_group_are_dealt_over_tasks(spark, tmp_path, monkeypatch, limit, tasks):
    """No split cuts a row group; one of millions of rows was ranked by a single task, and spilled."""
    monkeypatch.setattr(session, "SPLIT_ROWS", limit)
    spark.range(200_000).withColumn("same", F.lit("x")).coalesce(1).write.parquet(f"{tmp_path}/numbers.parquet")
    numbers = Tables(spark, str(tmp_path))["numbers"]
    assert numbers.columns == ["id", "same"]
    in_task = [row["count"] for row in numbers.groupBy(F.spark_partition_id()).count().collect()]
    assert len(in_task) == tasks and max(in_task) <= 1.2 * limit
    assert sorted(row.id for row in numbers.collect()) == list(range(200_000))


def test_an_empty_table_is_read(spark, tmp_path):
    spark.range(0).write.parquet(f"{tmp_path}/numbers.parquet")
    assert Tables(spark, str(tmp_path))["numbers"].count() == 0
