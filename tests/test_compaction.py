import pytest
import seed
from pyspark.sql import functions as F

from tidemark.sources import compaction, landing, staged, storage


def land_many(spark, root, batches, rows=4):
    for i in range(batches):
        data = [(f"ord_{i * rows + j:04}", "cus_1", "completed", "USD", seed.at(), seed.at(0, 1), False) for j in range(rows)]
        landing.land_batch(spark, root, f"shop{i}", {"orders": seed.source(spark, "orders", data)})
    staged.load_all_pending(spark, root)


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def test_many_batches_become_few_files_and_stay_the_same(spark, root):
    land_many(spark, root, 5)
    before = rows(staged.read_loaded(spark, root, "orders"))
    assert len(staged.read_loaded(spark, root, "orders").inputFiles()) >= 5
    path = compaction.compact_month(spark, root, "orders", "202601")
    assert rows(compaction.read_compacted(spark, root, "orders")) == before and len(before) == 20
    assert len(compaction.read_compacted(spark, root, "orders").where("load_month = '202601'").inputFiles()) >= 1
    assert len(spark.read.parquet(f"{path}/rows").inputFiles()) == 1
    late = [("ord_9999", "cus_1", "completed", "USD", seed.at(), seed.at(0, 2), False)]
    landing.land_batch(spark, root, "late", {"orders": seed.source(spark, "orders", late)})
    staged.load_all_pending(spark, root)
    assert compaction.read_compacted(spark, root, "orders").count() == 21
    small = compaction.compact_month(spark, root, "orders", "202601", target_bytes=2000)
    files = spark.read.parquet(f"{small}/rows").inputFiles()
    assert len(files) > 3
    assert len(compaction.key_files(spark, root, "orders", "ord_0007")) == 1
    found = compaction.lookup(spark, root, "orders", "ord_0007")
    assert [r.order_id for r in found.collect()] == ["ord_0007"]
    assert sum("/compact/" in name for name in found.inputFiles()) == 1
    assert compaction.lookup(spark, root, "orders", "zzz").collect() == []
    kept = rows(compaction.read_compacted(spark, root, "orders"))
    assert compaction.drop_replaced(spark, root, "orders") == 7
    assert rows(compaction.read_compacted(spark, root, "orders")) == kept
    assert not storage.exists(spark, path)


def test_a_rewrite_that_differs_is_not_used(spark, root, monkeypatch):
    land_many(spark, root, 2)
    before = rows(staged.read_loaded(spark, root, "orders"))
    real = compaction._written
    monkeypatch.setattr(compaction, "_written", lambda *a: real(*a).where(F.col("order_id") != "ord_0001"))
    with pytest.raises(RuntimeError, match="7/8"):
        compaction.compact_month(spark, root, "orders", "202601")
    monkeypatch.undo()
    assert rows(compaction.read_compacted(spark, root, "orders")) == before
