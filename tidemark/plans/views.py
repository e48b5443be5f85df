"""Commerce source tables and control ledgers derived from the star-schema test tables.

The constants and key rules below are fixed values, shared with the SQL twins.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import AUDIT, MONEY, RAW_TABLES
from tidemark.session import limit_rows, limit_splits

BATCH = "00000000-0000-5000-8000-00000000000"
CURRENCIES = ("USD", "EUR", "VND")


def _text(prefix: str, *values: Column | str) -> Column:
    parts = [F.col(v).cast("string") if isinstance(v, str) else v.cast("string") for v in values]
    return F.concat(F.lit(prefix), *parts)


def _ts(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def _mod(name: str, by: int) -> Column:
    return F.col(name) % by


def _sha(*values: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", *[(F.col(v) if isinstance(v, str) else v).cast("string") for v in values]), 256)


class Tables:
    """The test tables of one folder. A table's schema is looked up once."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        limit_splits(spark)
        self.spark, self.folder = spark, folder
        self._open: dict[str, DataFrame] = {}

    def _read(self, name: str) -> DataFrame:
        return limit_rows(self.spark.read.parquet(f"{self.folder}/{name}.parquet"))

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._open:
            self._open[name] = self._read(name)
        return self._open[name]


def _raw(df: DataFrame, table: str, columns: Mapping[str, Column], number: Column | None = None) -> DataFrame:
    """Add the columns most tables share, then put all in contract order.

    With ``number``, every sixth key has an earlier revision: one a day older in a batch of its own,
    which is a tombstone for every third of them (deleted, then revived), or one that ties on time
    and batch, so that the record hash decides.
    """
    at = columns["source_updated_at"]
    shared = {"is_deleted": F.lit(False), "batch_id": F.lit(BATCH + "1")}
    every = {**shared, **columns}
    if number is not None:
        df = df.withColumn("_earlier", F.explode(F.when(number % 6 == 0, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
        older = F.col("_earlier") & (number % 12 != 0)
        at = F.when(older, at - F.expr("INTERVAL 1 DAY")).otherwise(at)
        every |= {
            "source_updated_at": at,
            "is_deleted": F.when(F.col("_earlier"), older & (number % 18 == 0)).otherwise(every["is_deleted"]),
            "batch_id": F.when(older, BATCH + "0").otherwise(every["batch_id"]),
            "record_hash": F.when(F.col("_earlier"), _sha(every["record_hash"], F.lit("earlier"))).otherwise(every["record_hash"]),
        }
    every = {"updated_at": at, "ingested_at": at + F.expr("INTERVAL 1 HOUR"), **every}
    contract = [*RAW_TABLES[table].business.fields, *AUDIT.fields]
    return df.select(*[every[field.name].cast(field.dataType).alias(field.name) for field in contract])


def raw_customers(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    revisions = F.array_compact(F.array(F.lit(1), F.when(key % 5 == 0, 2), F.when(key % 11 == 0, 3)))
    nations = t["nation"].select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = t["customer"].join(nations, "c_nationkey").withColumn("r", F.explode(revisions))
    days = F.when(key % 7 == 0, 1).otherwise(F.col("r"))
    return _raw(rows, "customers", {
        "customer_id": _text("cus_", "c_custkey"),
        "email": F.concat(F.lower("c_name"), F.lit("-r"), F.col("r").cast("string"), F.lit("@example.test")),
        "country": F.when(key % 10 != 0, F.col("n_name")),
        "created_at": _ts("1995-01-01"),
        "is_deleted": F.col("r") == 3,
        "batch_id": _text(BATCH, "r"),
        "source_updated_at": F.date_add(F.lit("1995-01-01").cast("date"), days).cast("timestamp"),
        "record_hash": _sha("c_custkey", "r"),
    })


def raw_orders(t: Tables) -> DataFrame:
    status = F.col("o_orderstatus")
    place = _mod("o_orderkey", 3)
    currency = F.when(place == 0, CURRENCIES[0]).when(place == 1, CURRENCIES[1]).otherwise(CURRENCIES[2])
    return _raw(t["orders"], "orders", {
        "order_id": _text("ord_", "o_orderkey"),
        "customer_id": _text("cus_", "o_custkey"),
        "status": F.when(status == "F", "completed").when(status == "O", "pending").otherwise("cancelled"),
        "currency": currency,
        "ordered_at": F.col("o_orderdate").cast("timestamp"),
        "source_updated_at": F.col("o_orderdate").cast("timestamp"),
        "record_hash": _sha("o_orderkey"),
    }, F.col("o_orderkey"))


def raw_order_items(t: Tables) -> DataFrame:
    price = F.col("l_extendedprice").cast(MONEY)
    return _raw(t["lineitem"], "order_items", {
        "order_item_id": _text("item_", "l_orderkey", F.lit("-"), "l_linenumber"),
        "order_id": _text("ord_", "l_orderkey"),
        "product_id": _text("prod_", "l_partkey"),
        "quantity": F.col("l_quantity").cast("int"),
        "unit_price": price,
        "source_updated_at": F.col("l_shipdate").cast("timestamp"),
        "record_hash": _sha("l_partkey", "l_suppkey", price),
    }, F.col("l_orderkey"))


def raw_payments(t: Tables) -> DataFrame:
    failed = _mod("o_orderkey", 10) == 0
    at = F.col("o_orderdate").cast("timestamp")
    return _raw(t["orders"].where(_mod("o_orderkey", 17) != 0), "payments", {
        "payment_id": _text("pay_", "o_orderkey"),
        "order_id": _text("ord_", "o_orderkey"),
        "provider_transaction_id": _text("txn_", "o_orderkey"),
        "status": F.when(failed, "failed").otherwise("succeeded"),
        "amount": F.col("o_totalprice").cast(MONEY),
        "succeeded_at": F.when(~failed, at),
        "source_updated_at": at,
        "record_hash": _sha("o_orderkey"),
    }, F.col("o_orderkey"))


def raw_refunds(t: Tables) -> DataFrame:
    refunded = (_mod("o_orderkey", 4) == 0) & (_mod("o_orderkey", 10) != 0) & (_mod("o_orderkey", 17) != 0)
    failed = _mod("o_orderkey", 12) == 0
    at = F.col("o_orderdate").cast("timestamp")
    return _raw(t["orders"].where(refunded), "refunds", {
        "refund_id": _text("ref_", "o_orderkey"),
        "payment_id": _text("pay_", "o_orderkey"),
        "status": F.when(failed, "failed").otherwise("succeeded"),
        "amount": (F.lit(100) + _mod("o_orderkey", 400)).cast(MONEY),
        "succeeded_at": F.when(~failed, at),
        "source_updated_at": at,
        "record_hash": _sha("o_orderkey"),
    }, F.col("o_orderkey"))


def raw_events(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    named = F.when(kind == "view", "product_viewed").when(kind == "click", "add_to_cart").when(kind == "purchase", "checkout_completed")
    return _raw(t["events"], "events", {
        "event_id": _text("evt_", "event_id"),
        "event_type": F.coalesce(named, kind),
        "session_id": _text("sess_", "user_id", F.lit("_"), F.to_date("ts")),
        "customer_id": F.when(_mod("user_id", 6) != 0, _text("cus_", "user_id")),
        "product_id": F.when(_mod("event_id", 5) != 0, _text("prod_", _mod("event_id", 200))),
        "campaign_id": F.when(_mod("event_id", 10) != 0, _text("cmp_", _mod("user_id", 30))),
        "occurred_at": F.col("ts").cast("timestamp"),
        "is_deleted": _mod("event_id", 97) == 0,
        "source_updated_at": F.col("ts").cast("timestamp"),
        "record_hash": _sha("event_id"),
    }, F.col("event_id"))


def raw_marketing_campaigns(t: Tables) -> DataFrame:
    even = _mod("n_nationkey", 2) == 0
    return _raw(t["nation"], "marketing_campaigns", {
        "campaign_id": _text("cmp_", "n_nationkey"),
        "name": F.col("n_name"),
        "channel": F.when(even, "search").otherwise("social"),
        "starts_at": _ts("2024-01-01"),
        "ends_at": F.when(even, _ts("2024-02-01")),
        "source_updated_at": _ts("2024-01-01"),
        "record_hash": _sha("n_name"),
    }, F.col("n_nationkey"))


def raw_campaign_spend(t: Tables) -> DataFrame:
    return _raw(t["supplier"], "campaign_spend", {
        "spend_id": _text("spend_", "s_suppkey"),
        "campaign_id": _text("cmp_", _mod("s_suppkey", 28)),
        "spend_date": F.date_add(F.lit("2024-01-01").cast("date"), _mod("s_suppkey", 40).cast("int")),
        "amount": F.col("s_acctbal").cast(MONEY),
        "source_updated_at": _ts("2024-01-01"),
        "record_hash": _sha("s_name"),
    }, F.col("s_suppkey"))


def raw_product_catalog(t: Tables) -> DataFrame:
    return _raw(t["part"], "product_catalog", {
        "product_id": _text("prod_", "p_partkey"),
        "product_name": F.col("p_name"),
        "category": F.col("p_type"),
        "unit_cost": F.when(_mod("p_partkey", 10) != 0, F.col("p_retailprice").cast(MONEY)),
        "source_updated_at": _ts("1995-01-01"),
        "record_hash": _sha("p_partkey"),
    }, F.col("p_partkey"))


_RAW_VIEWS = {
    "customers": raw_customers,
    "orders": raw_orders,
    "order_items": raw_order_items,
    "payments": raw_payments,
    "refunds": raw_refunds,
    "events": raw_events,
    "marketing_campaigns": raw_marketing_campaigns,
    "campaign_spend": raw_campaign_spend,
    "product_catalog": raw_product_catalog,
}


class RawViews(Mapping):
    """All raw tables of one folder, each planned when it is first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.tables = Tables(spark, folder)
        self._planned: dict[str, DataFrame] = {}

    def _plan(self, name: str) -> DataFrame:
        return _RAW_VIEWS[name](self.tables)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._planned:
            self._planned[name] = self._plan(name)
        return self._planned[name]

    def __iter__(self):
        return iter(_RAW_VIEWS)

    def __len__(self) -> int:
        return len(_RAW_VIEWS)


def source_customers(t: Tables) -> DataFrame:
    """The relational source as it is now: first revisions, with every 13th key gone."""
    rows = t["customer"].where(_mod("c_custkey", 13) != 0)
    return rows.select(_text("cus_", "c_custkey").alias("customer_id"))


def batch_manifest(t: Tables) -> DataFrame:
    place, at = _mod("o_orderkey", 7), F.col("o_orderdate").cast("timestamp")
    status = F.when(place == 0, "FAILED").when(place == 1, "LOADING").when(place == 2, "QUARANTINED").when(
        place == 3, "STORED"
    ).otherwise("LOADED")
    return t["orders"].select(
        _text("batch_", "o_orderkey").alias("batch_id"),
        _text("src_", _mod("o_custkey", 5)).alias("source"),
        _mod("o_orderkey", 1000).cast("long").alias("row_count"),
        status.alias("status"),
        at.alias("created_at"),
        F.timestamp_add("HOUR", _mod("o_orderkey", 48).cast("int"), at).alias("updated_at"),
    )


def pipeline_run(t: Tables) -> DataFrame:
    kind, place, at = F.col("event_type"), _mod("event_id", 3), F.col("ts").cast("timestamp")
    done = F.timestamp_add("MINUTE", _mod("event_id", 120).cast("int"), at)
    return t["events"].select(
        _text("run_", "event_id").alias("run_id"),
        F.when(place == 0, "PIPELINE").when(place == 1, "BACKFILL").otherwise("PUBLISH").alias("run_type"),
        F.when(kind == "error", "FAILED").when(kind == "view", "RUNNING").otherwise("SUCCESS").alias("status"),
        F.when(_mod("user_id", 6) != 0, _text("src_", _mod("user_id", 5))).alias("source"),
        at.alias("started_at"),
        F.when(kind != "view", done).alias("finished_at"),
    )


def source_checkpoint(t: Tables) -> DataFrame:
    hours = _mod("s_suppkey", 72).cast("int")
    return t["supplier"].select(
        _text("src_", "s_suppkey").alias("source"),
        F.timestamp_add("HOUR", hours, _ts("2024-01-28")).alias("updated_at"),
    )


def publication_manifest(t: Tables) -> DataFrame:
    place = _mod("event_id", 3)
    dataset = F.when(place == 0, "mart_daily_revenue").when(place == 1, "mart_conversion_funnel").otherwise(
        "mart_customer_orders"
    )
    committed = _mod("event_id", 4) != 0
    return t["events"].select(
        _text("pub_", "event_id").alias("publication_id"),
        _text("run_", F.col("event_id") - _mod("event_id", 2)).alias("run_id"),
        dataset.alias("dataset"),
        F.concat(dataset, F.lit("__"), F.col("event_id").cast("string")).alias("snapshot_table"),
        F.when(committed, "COMMITTED").otherwise("FAILED").alias("status"),
        F.when(committed, F.col("ts").cast("timestamp")).alias("committed_at"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def dataset_release(t: Tables) -> DataFrame:
    place = _mod("event_id", 6)
    status = F.when(place == 0, "PREPARING").when(place == 1, "PARTIAL").when(place == 2, "FAILED").when(
        place == 3, "ROLLED_BACK"
    ).otherwise("COMMITTED")
    return t["events"].select(
        _text("rel_", "event_id").alias("release_id"),
        _text("run_", "event_id").alias("run_id"),
        status.alias("status"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


LEDGER_VIEWS = {
    "batch_manifest": batch_manifest,
    "pipeline_run": pipeline_run,
    "source_checkpoint": source_checkpoint,
    "publication_manifest": publication_manifest,
    "dataset_release": dataset_release,
}
