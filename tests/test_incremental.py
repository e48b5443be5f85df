import random
from datetime import timedelta

import pytest
import seed
from pyspark.sql import functions as F

from tidemark.operators.revisions import latest_live
from tidemark.plans import commerce, incremental
from tidemark.plans.incremental import TABLES, DailyRevenue, LatestRows
from tidemark.schemas import AUDIT, RAW_TABLES


def audited(spark, table, rows):
    """rows: business values, then batch, day of the source time, and hash."""
    contract = [*RAW_TABLES[table].business.fields, *AUDIT.fields]
    data = [(*values, batch, seed.at(day), seed.at(day), mark) for *values, batch, day, mark in rows]
    return spark.createDataFrame(data, type(RAW_TABLES[table].business)(contract))


def order(draw, i, batch):
    at = seed.at(draw.randint(0, 3))
    return (f"ord_{i}", f"cus_{i % 3}", "completed", draw.choice(["USD", "EUR"]), at, at, draw.random() < 0.2,
            f"b{batch}", draw.randint(0, 4), str(draw.random()))


def item(draw, i, batch):
    return (f"item_{i}", f"ord_{draw.randint(0, 9)}", "prod", draw.randint(1, 4), seed.money(draw.randint(1, 90)), seed.at(), draw.random() < 0.2,
            f"b{batch}", draw.randint(0, 4), str(draw.random()))


def payment(draw, i, batch):
    return (f"pay_{i}", f"ord_{draw.randint(0, 9)}", f"txn_{i}", draw.choice(["succeeded", "succeeded", "failed"]), seed.money(draw.randint(1, 90)),
            seed.at(), seed.at(), draw.random() < 0.2, f"b{batch}", draw.randint(0, 4), str(draw.random()))


def refund(draw, i, batch):
    return (f"ref_{i}", f"pay_{draw.randint(0, 9)}", draw.choice(["succeeded", "failed"]), seed.money(draw.randint(1, 9)), seed.at(), seed.at(),
            draw.random() < 0.2, f"b{batch}", draw.randint(0, 4), str(draw.random()))


MAKERS = {"orders": order, "order_items": item, "payments": payment, "refunds": refund}


def batch_of(spark, draw, number, sizes=(6, 10, 6, 6)):
    return {name: audited(spark, name, [MAKERS[name](draw, draw.randint(0, 9), number) for _ in range(n)]) for name, n in zip(TABLES, sizes)}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def rebuilt(logs):
    return commerce.mart_daily_revenue(commerce.core_order_financial(logs))


def test_snapshot_equals_full_ranking_for_any_batches(spark, root):
    draw = random.Random(1)
    log = None
    for number in range(4):
        part = audited(spark, "orders", [order(draw, draw.randint(0, 25), f"{number}-{draw.randint(0, 1)}") for _ in range(15)])
        log = part if log is None else log.unionByName(part)
    log = log.cache()
    kept = LatestRows(spark, root, "orders", 8)
    batches = sorted(r.batch_id for r in log.select("batch_id").distinct().collect())
    draw.shuffle(batches)
    for n in range(0, len(batches), 3):
        kept.refresh(log, batches[:n + 3])
        seen = log.where(F.col("batch_id").isin(batches[:n + 3]))
        assert rows(kept.live()) == rows(latest_live(seen, "order_id").select(*kept.store.schema.names))
    version = kept.version()
    assert kept.refresh(log, batches) == version
    log.unpersist()


def test_ties_tombstones_and_revivals(spark, root):
    kept = LatestRows(spark, root, "customers", 4)
    def customer(key, deleted, batch, day, mark):
        return (key, "a@example.test", None, seed.at(), seed.at(day), deleted, batch, day, mark)
    steps = [
        ("b2", [customer("dead", True, "b2", 5, "x"), customer("tie", False, "b2", 1, "m")]),
        ("b1", [customer("dead", False, "b1", 4, "y"), customer("tie", True, "b1", 1, "z")]),
        ("b3", [customer("dead", False, "b3", 6, "a"), customer("new", True, "b3", 1, "a")]),
    ]
    live = []
    for batch, data in steps:
        kept.refresh(audited(spark, "customers", data), [batch])
        live.append(sorted(r.customer_id for r in kept.live().collect()))
    assert live == [["tie"], ["tie"], ["dead", "tie"]]


def test_only_new_batches_and_touched_parts_are_read(spark, root):
    kept = LatestRows(spark, root, "orders", 16)
    draw = random.Random(2)
    log = audited(spark, "orders", [order(draw, i, 1) for i in range(200)])
    path = f"{root}/log"
    log.write.partitionBy("batch_id").parquet(path)
    late = audited(spark, "orders", [order(draw, 7, 2)])
    late.write.mode("append").partitionBy("batch_id").parquet(path)
    raw = spark.read.parquet(path)
    kept.refresh(raw, ["b1"])
    plan = raw.where(F.col("batch_id").isin(["b2"]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch_id" in plan
    before = kept.store.places(kept.version())
    kept.refresh(raw, ["b1", "b2"])
    after = kept.store.places(kept.version())
    touched = kept.store.parts_of(late)
    assert len(touched) == 1 and {part for part in after if after[part] != before.get(part)} == set(touched)
    read = kept.store.read(kept.version(), touched).inputFiles()
    assert read and all(f"_part={touched[0]}/" in name for name in read)
    assert rows(kept.rows().select("order_id", "batch_id")) == rows(
        latest_live(log.unionByName(late).withColumn("is_deleted", F.lit(False)), "order_id").select("order_id", "batch_id"))


@pytest.mark.parametrize("chance", [3])
def test_differences_equal_a_rebuild(spark, root, chance):
    draw = random.Random(chance)
    view, logs = DailyRevenue(spark, root, 3), {}
    assert view.read().collect() == []
    for number in range(4):
        part = batch_of(spark, draw, number) if number != 2 else {"refunds": batch_of(spark, draw, number)["refunds"]}
        logs = {name: logs[name].unionByName(part[name]) if name in logs and name in part else part.get(name, logs.get(name)) for name in TABLES}
        if number == 1:  # a run that died in the middle is repeated
            view.latest["orders"].merge(part["orders"], 2)
            view.latest["payments"].merge(part["payments"].limit(2), 2)
            view = DailyRevenue(spark, root, 3)
        assert view.apply(part) == number + 1
        assert rows(view.read()) == rows(rebuilt(logs))
    assert view.apply({}) == 5 and view.differences(5).isEmpty()
    view.FOLD = 2
    assert view.apply(part) == 6
    assert view._state() == (6, [-6])
    assert rows(view.read()) == rows(rebuilt(logs))


def test_late_refund_changes_only_its_day(spark, root):
    view = DailyRevenue(spark, root, 4)
    raw = {name: df for name, df in seed.raw(spark).items() if name in TABLES}
    view.apply(raw)
    assert rows(view.read()) == rows(rebuilt(raw))
    late = raw["refunds"].limit(1).withColumns({
        "refund_id": F.lit("ref_late"), "amount": F.lit(seed.money(5)), "source_updated_at": F.col("source_updated_at") + timedelta(days=9)})
    run = view.apply({"refunds": late})
    (change,) = view.differences(run).collect()
    assert (change.paid_orders, change.refunded_revenue, change.net_revenue) == (0, seed.money(5), seed.money(-5))
    assert rows(view.read()) == rows(rebuilt({**raw, "refunds": raw["refunds"].unionByName(late)}))


def test_first_rows_are_ranked_once(spark, root, monkeypatch):
    """Rows that meet no stored part are unique already; ranking them again would shuffle them all."""
    ranked = []
    real = incremental.newest_per_key
    monkeypatch.setattr(incremental, "newest_per_key", lambda *args: ranked.append(1) or real(*args))
    log = seed.raw(spark)["orders"]
    kept = LatestRows(spark, root, "orders", 8)
    kept.merge(log, 1)
    assert len(ranked) == 1
    kept.merge(log, 2)
    assert len(ranked) == 3
    assert kept.rows(2).count() == kept.rows(1).count() > 0


def test_whole_rows_are_written_once_and_first_ones_are_not_looked_up(spark, root, monkeypatch):
    """A copy of all new rows was written before they went to their parts, and joined with their own keys after it."""
    looked = []
    real = incremental.PartStore.lookup
    monkeypatch.setattr(incremental.PartStore, "lookup", lambda self, keys, at: looked.append(at) or real(self, keys, at))
    view = DailyRevenue(spark, root, 4)
    raw = {name: df for name, df in seed.raw(spark).items() if name in TABLES}
    view.apply(raw)
    assert looked == []
    view.apply(raw)
    assert set(looked) == {1, 2}
    assert spark.read.parquet(view.latest["orders"].scratch).columns == ["order_id"]
    assert rows(view.read()) == rows(rebuilt(raw))


def test_rows_in_parts_that_were_not_read_are_refused(spark, root):
    kept = LatestRows(spark, root, "orders", 8)
    kept.merge(seed.raw(spark)["orders"], 1)
    with pytest.raises(RuntimeError, match="not read"):
        kept.store.write(kept.rows(1), kept.store.parts_of(kept.rows(1))[1:], 2)
