"""Fixed table contracts: raw revision tables, marts and control ledgers.

Column names, types, keys and allowed values are fixed values that readers and writers agree on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
TOTAL = T.DecimalType(38, 2)

_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "bool": T.BooleanType(),
    "date": T.DateType(),
    "ts": T.TimestampType(),
    "money": MONEY,
    "total": TOTAL,
}


def struct(spec: str) -> T.StructType:
    """A schema from ``name:type`` words; a trailing ``?`` marks a nullable column."""
    fields = []
    for word in spec.split():
        name, kind = word.split(":")
        fields.append(T.StructField(name, _TYPES[kind.rstrip("?")], kind.endswith("?")))
    return T.StructType(fields)


@dataclass(frozen=True)
class RawTable:
    key: str
    cursor: str
    month_of: str
    business: T.StructType

    @property
    def columns(self) -> list[str]:
        return self.business.names


AUDIT = struct("batch_id:string source_updated_at:ts ingested_at:ts record_hash:string")

RAW_TABLES: dict[str, RawTable] = {
    "customers": RawTable(
        "customer_id", "updated_at", "updated_at",
        struct("customer_id:string email:string country:string? created_at:ts updated_at:ts is_deleted:bool"),
    ),
    "orders": RawTable(
        "order_id", "updated_at", "ordered_at",
        struct(
            "order_id:string customer_id:string status:string currency:string ordered_at:ts "
            "updated_at:ts is_deleted:bool"
        ),
    ),
    "order_items": RawTable(
        "order_item_id", "updated_at", "updated_at",
        struct(
            "order_item_id:string order_id:string product_id:string quantity:int unit_price:money "
            "updated_at:ts is_deleted:bool"
        ),
    ),
    "payments": RawTable(
        "payment_id", "updated_at", "updated_at",
        struct(
            "payment_id:string order_id:string provider_transaction_id:string status:string amount:money "
            "succeeded_at:ts? updated_at:ts is_deleted:bool"
        ),
    ),
    "refunds": RawTable(
        "refund_id", "updated_at", "updated_at",
        struct(
            "refund_id:string payment_id:string status:string amount:money succeeded_at:ts? "
            "updated_at:ts is_deleted:bool"
        ),
    ),
    "events": RawTable(
        "event_id", "occurred_at", "occurred_at",
        struct(
            "event_id:string event_type:string session_id:string customer_id:string? product_id:string? "
            "campaign_id:string? occurred_at:ts updated_at:ts is_deleted:bool"
        ),
    ),
    "marketing_campaigns": RawTable(
        "campaign_id", "updated_at", "updated_at",
        struct(
            "campaign_id:string name:string channel:string starts_at:ts ends_at:ts? updated_at:ts is_deleted:bool"
        ),
    ),
    "campaign_spend": RawTable(
        "spend_id", "updated_at", "spend_date",
        struct("spend_id:string campaign_id:string spend_date:date amount:money updated_at:ts is_deleted:bool"),
    ),
    "product_catalog": RawTable(
        "product_id", "updated_at", "updated_at",
        struct(
            "product_id:string product_name:string category:string unit_cost:money? updated_at:ts is_deleted:bool"
        ),
    ),
}

# Tables of the relational source, the ones whose hard deletes are reconciled.
RELATIONAL_TABLES = ("customers", "orders", "order_items", "payments", "refunds", "events")

SOURCE_RECORDS = struct("source:string table_name:string record_json:string")

EVENT_TYPES = ("product_viewed", "add_to_cart", "checkout_completed")

MARTS: dict[str, T.StructType] = {
    "mart_daily_revenue": struct(
        "grain_key:string order_date:date currency:string paid_orders:long gross_order_value:total "
        "captured_revenue:total refunded_revenue:total net_revenue:total published_at:ts"
    ),
    "mart_conversion_funnel": struct(
        "event_date:date campaign_id:string? campaign_name:string channel:string viewing_sessions:long "
        "cart_sessions:long checkout_sessions:long viewing_users:long campaign_spend:total "
        "session_conversion_rate:double published_at:ts"
    ),
    "mart_customer_orders": struct(
        "order_id:string order_date:date ordered_at:ts customer_id:string customer_email:string country:string? "
        "order_status:string currency:string gross_amount:total paid_amount:total refunded_amount:total "
        "net_amount:total published_at:ts"
    ),
}

LEDGERS: dict[str, T.StructType] = {
    "batch_manifest": struct(
        "batch_id:string source:string object_prefix:string checksum:string row_count:long watermark:string "
        "status:string error:string? created_at:ts updated_at:ts"
    ),
    "source_checkpoint": struct("source:string watermark:string batch_id:string? updated_at:ts"),
    "backfill_request": struct(
        "request_id:string source:string window_start:date window_end:date reason:string status:string "
        "dry_run:bool updated_at:ts"
    ),
    "publication_manifest": struct(
        "publication_id:string run_id:string dataset:string candidate_path:string candidate_checksum:string "
        "previous_path:string? previous_checksum:string? production_checksum:string? status:string error:string? "
        "committed_at:ts? rollback_of:string? updated_at:ts"
    ),
    "part_version": struct("table_name:string version:long parts:string batches:string updated_at:ts"),
    "compaction": struct("table_name:string month:string path:string batches:string row_count:long updated_at:ts"),
    "publication_event": struct("publication_id:string event_type:string details:string created_at:ts"),
}

BATCH_OBJECTS = struct("table_name:string object_path:string checksum:string size_bytes:long row_count:long")
