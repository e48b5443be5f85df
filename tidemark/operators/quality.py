"""Data tests. Each returns its violations, or one row per rule with their number."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import age_seconds
from tidemark.operators.revisions import append_union, key_set
from tidemark.schemas import EVENT_TYPES

HOUR = 3600
FRESH_WARN = 26 * HOUR
FRESH_ERROR = 72 * HOUR


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once; NULL keys are left to the not-null test."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("occurrences"))
    return counts.where(F.col("occurrences") > 1)


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULLs per column, all columns in one pass."""
    counted = df.agg(*[F.count_if(F.col(name).isNull()).alias(name) for name in columns])
    return counted.unpivot([], list(columns), "column_name", "null_rows")


def funnel_not_monotonic(funnel: DataFrame) -> DataFrame:
    return funnel.where(
        (F.col("checkout_sessions") > F.col("cart_sessions")) | (F.col("cart_sessions") > F.col("viewing_sessions"))
    )


def negative_financials(orders: DataFrame) -> DataFrame:
    return orders.where(
        (F.col("gross_amount") < 0)
        | (F.col("paid_amount") < 0)
        | (F.col("refunded_amount") < 0)
        | (F.col("refunded_amount") > F.col("paid_amount"))
    )


def freshness(tables: Mapping[str, DataFrame], as_of: Column) -> DataFrame:
    """Age of the newest load per table and whether it is fresh, late or too old.

    A table that was never loaded is too old.
    """
    newest = append_union(
        [
            df.agg(F.max("ingested_at").alias("newest")).select(F.lit(name).alias("table_name"), "newest")
            for name, df in sorted(tables.items())
        ]
    )
    age = age_seconds(as_of, "newest")
    status = F.when(age.isNull() | (age > FRESH_ERROR), "error").when(age > FRESH_WARN, "warn").otherwise("pass")
    return newest.select("table_name", age.alias("age_seconds"), status.alias("status"))


def source_net(payments: DataFrame, refunds: DataFrame) -> DataFrame:
    """Succeeded payments less succeeded refunds, orphan refunds included.

    Takes the rows that stand: rows of the source, or the newest live revision of each key. A log of
    revisions has to be ranked first, or a revised payment counts twice.
    """
    good = (F.col("status") == "succeeded") & ~F.col("is_deleted")
    flows = payments.where(good).select("amount").unionByName(refunds.where(good).select((-F.col("amount")).alias("amount")))
    return flows.agg(F.coalesce(F.sum("amount"), F.lit(0)).cast("decimal(38,2)").alias("source_net"))


def reconcile_net(revenue: DataFrame, payments: DataFrame, refunds: DataFrame) -> DataFrame:
    """Served net revenue against the source, with the number of served rows."""
    served = revenue.agg(
        F.coalesce(F.sum("net_revenue"), F.lit(0)).cast("decimal(38,2)").alias("gold_net"),
        F.count(F.lit(1)).alias("gold_rows"),
        F.lit(None).cast("decimal(38,2)").alias("source_net"),
    )
    source = source_net(payments, refunds).select(
        F.lit(None).cast("decimal(38,2)").alias("gold_net"), F.lit(0).cast("long").alias("gold_rows"), "source_net"
    )
    both = served.unionByName(source).agg(
        F.max("gold_net").alias("gold_net"), F.max("source_net").alias("source_net"), F.sum("gold_rows").alias("gold_rows")
    )
    return both.withColumn("reconciled", (F.col("gold_net") == F.col("source_net")) & (F.col("gold_rows") > 0))


def _rules(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    counted = df.agg(*[F.count_if(broken).alias(name) for name, broken in rules.items()])
    return counted.unpivot([], list(rules), "rule", "violations")


def _unknown_parents(name: str, child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows without a parent. Children are counted per value first, so a parent with very
    many children reaches the join as one row."""
    counted = child.where(F.col(column).isNotNull()).groupBy(F.col(column).alias(key)).agg(
        F.count(F.lit(1)).alias("n")
    )
    lost = counted.join(key_set(parent, key), key, "left_anti")
    return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")).select(F.lit(name).alias("rule"), "violations")


def source_contract(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows that break each rule of the relational source: values, parents and uniqueness.

    Row rules of one table share a scan; the parent and uniqueness rules aggregate by key first.
    """
    items, payments, refunds = tables["order_items"], tables["payments"], tables["refunds"]
    repeated = duplicate_keys(payments, "provider_transaction_id").agg(
        F.count(F.lit(1)).alias("violations")
    ).select(F.lit("payments_transaction_unique").alias("rule"), "violations")
    return append_union(
        [
            _rules(tables["events"], {"events_type": ~F.col("event_type").isin(*EVENT_TYPES)}),
            _rules(items, {"items_quantity": F.col("quantity") <= 0, "items_price": F.col("unit_price") < 0}),
            _rules(payments, {"payments_amount": F.col("amount") < 0}),
            _rules(refunds, {"refunds_amount": F.col("amount") < 0}),
            _rules(tables["campaign_spend"], {"spend_amount": F.col("amount") < 0}),
            _unknown_parents("orders_customer", tables["orders"], "customer_id", tables["customers"], "customer_id"),
            _unknown_parents("items_order", items, "order_id", tables["orders"], "order_id"),
            _unknown_parents("payments_order", payments, "order_id", tables["orders"], "order_id"),
            _unknown_parents("refunds_payment", refunds, "payment_id", payments, "payment_id"),
            _unknown_parents(
                "spend_campaign", tables["campaign_spend"], "campaign_id", tables["marketing_campaigns"], "campaign_id"
            ),
            repeated,
        ]
    )


def mart_tests(revenue: DataFrame, funnel: DataFrame, orders: DataFrame) -> DataFrame:
    """All tests of the marts with their number of violations."""

    def rows(test: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(test).alias("test"), "violations")

    def nulls(mart: str, df: DataFrame, columns: Sequence[str]) -> DataFrame:
        named = F.concat(F.lit(f"not_null {mart}."), F.col("column_name"))
        return null_counts(df, columns).select(named.alias("test"), F.col("null_rows").alias("violations"))

    return append_union(
        [
            rows("unique mart_daily_revenue.grain_key", duplicate_keys(revenue, "grain_key")),
            nulls("mart_daily_revenue", revenue, ["grain_key", "order_date", "currency", "net_revenue"]),
            nulls("mart_conversion_funnel", funnel, ["event_date", "campaign_id"]),
            rows("unique mart_customer_orders.order_id", duplicate_keys(orders, "order_id")),
            nulls("mart_customer_orders", orders, ["order_id", "customer_id"]),
            rows("funnel monotonic", funnel_not_monotonic(funnel)),
            rows("nonnegative financials", negative_financials(orders)),
        ]
    )
