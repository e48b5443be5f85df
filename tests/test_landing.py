import random

import pytest
import seed
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.checksums import table_digests
from tidemark.operators.revisions import latest_live
from tidemark.plans import ingest
from tidemark.schemas import RAW_TABLES
from tidemark.sources import landing, raw, storage
from tidemark.sources.ledger import Ledger


def land(spark, root, names=("orders", "payments"), **options):
    return landing.land_batch(spark, root, "shop", seed.sources(spark, names), **options)


def test_identity_ignores_order_and_partitioning(spark):
    rows = seed.ROWS["events"]
    shuffled = rows[:]
    random.Random(3).shuffle(shuffled)
    def identity(data, parts=1):
        digests = table_digests({"events": seed.source(spark, "events", data).repartition(parts)}).collect()
        return landing.batch_identity("shop", {r.table_name: r.asDict() for r in digests})
    first = identity(rows)
    assert first == identity(shuffled, 5)
    assert first != identity(rows[1:])
    assert first != identity(rows + rows[:1])
    assert first != landing.batch_identity("other", {"events": {}})


def test_digest_tells_nulls_and_separators_apart(spark):
    pairs = [(None, "a"), ("a", None), ("", "a"), ("a", ""), ("1:a", ""), ("-", "-"), (None, None)]
    seen = set()
    for pair in pairs:
        df = spark.createDataFrame([pair], "x string, y string")
        seen.add(tuple(table_digests({"t": df}).first()))
    assert len(seen) == len(pairs)


def test_landing_twice_is_landing_once(spark, root):
    first = land(spark, root)
    assert first.row_count == 6 and not first.reused
    mark = landing.checkpoint(spark, root, "shop")
    assert mark == {"updated_at": seed.at(2, 2).isoformat()}
    again = land(spark, root, watermark={"updated_at": "later"})
    assert again.reused and again.batch_id == first.batch_id
    assert landing.checkpoint(spark, root, "shop") == mark
    assert Ledger(spark, root, "batch_manifest").entries().count() == 1
    path = landing.table_path(root, "shop", "orders", first.batch_id)
    assert spark.read.parquet(path).count() == 3


def test_empty_extract_makes_no_batch(spark, root):
    empty = {name: seed.source(spark, name, []) for name in ("orders", "payments")}
    assert landing.land_batch(spark, root, "shop", empty) is None
    assert landing.checkpoint(spark, root, "shop") == {}
    filtered = {"orders": seed.source(spark, "orders").where(F.lit(False))}
    assert landing.land_batch(spark, root, "shop", filtered) is None


def test_crash_before_the_manifest_is_repaired_by_the_repeat(spark, root, monkeypatch):
    def crash(self, *entries):
        raise RuntimeError("lost driver")
    with monkeypatch.context() as patch:
        patch.setattr(Ledger, "append", crash)
        with pytest.raises(RuntimeError, match="lost driver"):
            land(spark, root)
    batch = land(spark, root)
    assert not batch.reused
    objects = landing.batch_objects(spark, root, batch.batch_id)
    assert objects.agg(F.sum("row_count")).first()[0] == 6
    assert raw.load_pending(spark, root) == [batch.batch_id]
    assert raw.read_raw(spark, root, "orders").count() == 3


def test_loading_is_idempotent_and_typed(spark, root):
    batch = land(spark, root)
    assert raw.load_pending(spark, root) == [batch.batch_id]
    assert raw.load_pending(spark, root) == []
    assert raw.load_batch(spark, root, batch.batch_id) is False
    rows = raw.read_raw(spark, root, "payments")
    assert rows.count() == 3
    first = rows.orderBy("payment_id").first()
    assert first.batch_id == batch.batch_id and first.load_month == "202601" and len(first.record_hash) == 64
    assert first.source_updated_at == first.updated_at
    assert dict(rows.dtypes)["amount"] == "decimal(18,2)"


def test_load_that_died_after_the_append_is_finished_without_doubles(spark, root, monkeypatch):
    batch = land(spark, root)
    with monkeypatch.context() as patch:
        patch.setattr(raw, "append_raw", lambda rows, root, table, real=raw.append_raw: real(rows, root, table) - 1)
        with pytest.raises(RuntimeError, match="count mismatch"):
            raw.load_batch(spark, root, batch.batch_id)
    assert Ledger(spark, root, "batch_manifest").find(batch_id=batch.batch_id).status == "FAILED"
    assert raw.load_pending(spark, root) == [batch.batch_id]
    assert raw.read_raw(spark, root, "orders").count() == 3
    assert raw.read_raw(spark, root, "payments").count() == 3


def test_partial_batch_is_refused(spark, root):
    batch = land(spark, root, names=("orders",))
    contract = RAW_TABLES["orders"]
    one = seed.source(spark, "orders").limit(1)
    raw.append_raw(raw.typed_revisions(one, contract, batch.batch_id, F.current_timestamp()), root, "orders")
    with pytest.raises(RuntimeError, match="partial batch"):
        raw.load_batch(spark, root, batch.batch_id)


def test_changed_file_is_refused(spark, root):
    batch = land(spark, root, names=("orders",))
    path = landing.table_path(root, "shop", "orders", batch.batch_id)
    seed.source(spark, "orders").limit(2).write.mode("overwrite").parquet(path)
    with pytest.raises(RuntimeError, match="differ from the manifest"):
        raw.load_batch(spark, root, batch.batch_id)
    assert not storage.exists(spark, raw.raw_path(root, "orders"))


def test_unknown_batch(spark, root):
    with pytest.raises(ValueError, match="unknown batch"):
        raw.load_batch(spark, root, "nope")


def test_unknown_table_lands_as_json(spark, root):
    df = spark.createDataFrame([("t1", None, seed.at()), ("t2", "é", seed.at(1))], "id string, note string, occurred_at timestamp")
    batch = landing.land_batch(spark, root, "crm", {"tickets": df})
    raw.load_pending(spark, root)
    rows = raw.read_raw(spark, root, "tickets").orderBy("source_updated_at").collect()
    assert [r.table_name for r in rows] == ["tickets", "tickets"]
    assert rows[0].record_json == '{"id":"t1","note":null,"occurred_at":"2026-01-01T09:00:00.000Z"}'
    back = raw.read_raw(spark, root, "tickets").select(F.from_json("record_json", df.schema).alias("r")).select("r.*")
    assert back.exceptAll(df).isEmpty() and df.exceptAll(back).isEmpty()
    assert raw.load_batch(spark, root, batch.batch_id) is False


def test_record_without_a_time_fails(spark, root):
    rows = [("r", "p", "succeeded", seed.money(1), None, None, False)]
    loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in RAW_TABLES["refunds"].business.fields])
    df = spark.createDataFrame(rows, loose)
    landing.land_batch(spark, root, "shop", {"refunds": df})
    with pytest.raises(Exception, match="updated_at is required"):
        raw.load_pending(spark, root)
    generic = landing.land_batch(spark, root, "crm", {"tickets": df.select("refund_id", "updated_at")})
    with pytest.raises(Exception, match="no source timestamp"):
        raw.load_batch(spark, root, generic.batch_id)


def test_layout_prunes_by_month_and_batch(spark, root):
    batch = land(spark, root, names=("customers", "events"))
    raw.load_pending(spark, root)
    df = raw.read_raw(spark, root, "events").where((F.col("batch_id") == batch.batch_id) & (F.col("load_month") == "202601"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch_id" in plan and "load_month" in plan.split("PartitionFilters")[1]
    assert df.count() == 8


def test_incremental_run_reads_back_to_the_lookback(spark, root):
    first = ingest.ingest_tables(spark, root, "shop", seed.sources(spark, ("orders",)))
    assert first.row_count == 3
    newer = seed.ROWS["orders"] + [("ord_004", "cus_003", "pending", "USD", seed.at(3), seed.at(3), False)]
    second = ingest.ingest_tables(spark, root, "shop", {"orders": seed.source(spark, "orders", newer)})
    # The watermark is the update of ord_003; two hours back from it only that order is read again.
    assert second.row_count == 2
    assert landing.checkpoint(spark, root, "shop")["updated_at"] == seed.at(3).isoformat()
    raw.load_pending(spark, root)
    log = raw.read_raw(spark, root, "orders")
    assert log.count() == 5 and latest_live(log, "order_id").count() == 4


def test_unchanged_catalog_is_skipped(spark, root, tmp_path):
    path = tmp_path / "catalog.csv"
    path.write_text("product_id,product_name,category,unit_cost,updated_at\np,n,c,1,2026-01-01T00:00:00Z\n")
    assert ingest.ingest_catalog(spark, root, str(path)).row_count == 1
    assert ingest.ingest_catalog(spark, root, str(path)) is None


def test_backfill_loads_its_window_and_leaves_the_checkpoint(spark, root):
    tables = seed.sources(spark, ("orders", "events"))
    plan = ingest.plan_backfill("shop", seed.date(2026, 1, 2), seed.date(2026, 1, 2), "lost day", {"shop"}, seed.date(2026, 2, 1))
    assert ingest.run_backfill(spark, root, plan, tables, dry_run=True) is None
    batch = ingest.run_backfill(spark, root, plan, tables)
    assert batch.row_count == 4 and batch.watermark["backfill"] is True
    assert landing.checkpoint(spark, root, "shop") == {}
    assert ingest.run_backfill(spark, root, plan, tables).reused
    assert raw.read_raw(spark, root, "events").count() == 3
    states = [r.status for r in Ledger(spark, root, "backfill_request").entries().orderBy("recorded_ns").collect()]
    assert states == ["PLANNED", "RUNNING", "SUCCESS", "RUNNING", "SUCCESS"]


@pytest.mark.parametrize(
    ("source", "start", "end", "reason", "message"),
    [
        ("nope", (2026, 1, 1), (2026, 1, 2), "because", "unknown source"),
        ("shop", None, (2026, 1, 2), "because", "needs a start"),
        ("shop", (2026, 1, 3), (2026, 1, 2), "because", "after the end"),
        ("shop", (2026, 1, 3), (2027, 1, 2), "because", "future"),
        ("shop", (2024, 1, 3), (2026, 1, 2), "because", "366"),
        ("shop", (2026, 1, 1), (2026, 1, 2), " x ", "reason"),
    ],
)
def test_backfill_requests_are_checked(source, start, end, reason, message):
    start, end = (seed.date(*d) if d else None for d in (start, end))
    with pytest.raises(ValueError, match=message):
        ingest.plan_backfill(source, start, end, reason, {"shop"}, seed.date(2026, 2, 1))


def test_hard_deletes_become_tombstones_once(spark, root):
    land(spark, root, names=("customers", "orders"))
    raw.load_pending(spark, root)
    left = {"customers": seed.source(spark, "customers").where("customer_id <> 'cus_003'"),
            "orders": seed.source(spark, "orders")}
    batch = ingest.reconcile_hard_deletes(spark, root, "shop", left, now=seed.at(9))
    assert batch.row_count == 1
    live = latest_live(raw.read_raw(spark, root, "customers"), "customer_id")
    assert sorted(r.customer_id for r in live.collect()) == ["cus_001", "cus_002"]
    assert ingest.reconcile_hard_deletes(spark, root, "shop", left, now=seed.at(10)) is None
    # The customer comes back with a newer update.
    back = [("cus_003", "chris@example.test", None, seed.at(-10), seed.at(12), False)]
    landing.land_batch(spark, root, "shop", {"customers": seed.source(spark, "customers", back)})
    raw.load_pending(spark, root)
    assert latest_live(raw.read_raw(spark, root, "customers"), "customer_id").count() == 3
