"""Staging views, order finance and the three marts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import (
    count_distinct_if,
    grain_key,
    guarded_ratio,
    sum_if,
    total,
    total_or_zero,
    utc_day,
)
from tidemark.operators.joins import left_join_defaults
from tidemark.operators.revisions import latest_live
from tidemark.schemas import EVENT_TYPES, MARTS, RAW_TABLES

VIEWED, IN_CART, CHECKED_OUT = EVENT_TYPES


def staging(raw: Mapping[str, DataFrame], table: str) -> DataFrame:
    """The live rows of one raw table."""
    return latest_live(raw[table], RAW_TABLES[table].key)


def order_gross(items: DataFrame) -> DataFrame:
    line = F.col("quantity") * F.col("unit_price")
    return items.groupBy("order_id").agg(total(F.sum(line)).alias("gross_amount"))


def order_paid(payments: DataFrame) -> DataFrame:
    paid = sum_if(F.col("status") == "succeeded", "amount")
    return payments.groupBy("order_id").agg(paid.alias("paid_amount"))


def _refunds_by_payment(refunds: DataFrame) -> DataFrame:
    refunded = sum_if(F.col("status") == "succeeded", "amount")
    return refunds.groupBy("payment_id").agg(refunded.alias("refunded_amount"))


def refunds_by_order(refunds: DataFrame, payments: DataFrame) -> DataFrame:
    """Succeeded refunds per order, reached through the payment they belong to.

    Refunds are summed per payment before the join, so a payment with very many refunds meets
    the join as one row.
    """
    joined = _refunds_by_payment(refunds).join(payments.select("payment_id", "order_id"), "payment_id")
    return joined.groupBy("order_id").agg(total(F.sum("refunded_amount")).alias("refunded_amount"))


def order_settlements(payments: DataFrame, refunds: DataFrame) -> DataFrame:
    """Paid and refunded amounts per order from one pass over the payments.

    Live payments are unique per payment id, so a left join with the refund sums keeps every
    payment once and one grouping by order serves both amounts.
    """
    settled = payments.join(_refunds_by_payment(refunds), "payment_id", "left")
    return settled.groupBy("order_id").agg(
        sum_if(F.col("status") == "succeeded", "amount").alias("paid_amount"),
        total_or_zero(F.sum("refunded_amount")).alias("refunded_amount"),
    )


def core_order_financial(raw: Mapping[str, DataFrame]) -> DataFrame:
    """One row per live order with its gross, paid, refunded and net amount.

    Both sides of each join hold an order once, already placed by ``order_id`` by the ranking and
    the groupings below them, so the joins add no shuffle and cannot fan out. Late refunds stay
    on the day of the order.
    """
    gross = order_gross(staging(raw, "order_items"))
    settled = order_settlements(staging(raw, "payments"), staging(raw, "refunds"))
    joined = staging(raw, "orders").join(gross, "order_id", "left").join(settled, "order_id", "left")
    paid, refunded = total_or_zero("paid_amount"), total_or_zero("refunded_amount")
    return joined.select(
        "order_id",
        "customer_id",
        F.col("status").alias("order_status"),
        "currency",
        "ordered_at",
        utc_day("ordered_at").alias("order_date"),
        total_or_zero("gross_amount").alias("gross_amount"),
        paid.alias("paid_amount"),
        refunded.alias("refunded_amount"),
        total(paid - refunded).alias("net_amount"),
    )


def mart_daily_revenue(core: DataFrame) -> DataFrame:
    """Revenue per order date and currency over orders with a positive paid amount."""
    paid = core.where(F.col("paid_amount") > 0)
    daily = paid.groupBy("order_date", "currency").agg(
        F.count_if(F.col("paid_amount") > 0).alias("paid_orders"),
        total(F.sum("gross_amount")).alias("gross_order_value"),
        total(F.sum("paid_amount")).alias("captured_revenue"),
        total(F.sum("refunded_amount")).alias("refunded_revenue"),
        total(F.sum("net_amount")).alias("net_revenue"),
    )
    return daily.select(
        grain_key("order_date", "currency").alias("grain_key"),
        "order_date",
        "currency",
        "paid_orders",
        "gross_order_value",
        "captured_revenue",
        "refunded_revenue",
        "net_revenue",
    )


def mart_customer_orders(core: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders of live customers.

    The join has to stay a plain one between two shuffles of its own: adaptive execution then cuts a
    customer with very many orders into several tasks, at any size and for any number of such customers.
    """
    profile = customers.select("customer_id", F.col("email").alias("customer_email"), "country")
    joined = core.join(profile, "customer_id")
    return joined.select(*[name for name in MARTS["mart_customer_orders"].names if name != "published_at"])


def _campaign_events(events: DataFrame) -> DataFrame:
    return events.where(F.col("campaign_id").isNotNull()).withColumn("event_date", utc_day("occurred_at"))


def campaign_event_distincts(events: DataFrame) -> DataFrame:
    """The funnel counts written as four conditional distinct counts.

    Plain but costly: Spark turns every row into one row per distinct set. Used to check
    ``campaign_event_metrics``.
    """
    kind = F.col("event_type")
    return _campaign_events(events).groupBy("event_date", "campaign_id").agg(
        count_distinct_if(kind == VIEWED, "session_id").alias("viewing_sessions"),
        count_distinct_if(kind == IN_CART, "session_id").alias("cart_sessions"),
        count_distinct_if(kind == CHECKED_OUT, "session_id").alias("checkout_sessions"),
        count_distinct_if(kind == VIEWED, "customer_id").alias("viewing_users"),
    )


def campaign_event_metrics(events: DataFrame) -> DataFrame:
    """Distinct sessions per funnel step and distinct viewing users per day and campaign.

    Each event becomes its session and, when it is a view by a known customer, its customer. The
    first grouping reduces them to one row per session or customer with a mask of the steps it
    took; the second one adds up the masks. The id is part of the first shuffle key, so a
    campaign with most of the traffic is spread over all tasks, and the counts are exact.
    """
    kind = F.col("event_type")
    step = F.when(kind == VIEWED, 1).when(kind == IN_CART, 2).when(kind == CHECKED_OUT, 4).otherwise(0)
    session = F.struct(F.lit("s").alias("who"), F.col("session_id").alias("id"), step.alias("step"))
    user = F.struct(F.lit("u").alias("who"), F.col("customer_id").alias("id"), F.lit(8).alias("step"))
    seen = F.when((kind == VIEWED) & F.col("customer_id").isNotNull(), F.array(session, user)).otherwise(
        F.array(session)
    )
    actors = _campaign_events(events).select("event_date", "campaign_id", F.explode(seen).alias("actor"))
    masks = actors.groupBy("event_date", "campaign_id", "actor.who", "actor.id").agg(
        F.bit_or("actor.step").alias("steps")
    )
    def took(bit: int) -> Column:
        return F.count_if(F.col("steps").bitwiseAND(bit) != 0)

    return masks.groupBy("event_date", "campaign_id").agg(
        took(1).alias("viewing_sessions"),
        took(2).alias("cart_sessions"),
        took(4).alias("checkout_sessions"),
        took(8).alias("viewing_users"),
    )


SKETCHES = ("viewing_sessions", "cart_sessions", "checkout_sessions", "viewing_users")


def campaign_sketches(events: DataFrame, precision: int = 14) -> DataFrame:
    """Distinct-count sketches per day and campaign that can be stored and united for any span of days.

    The relative standard error is about 1.04 / sqrt(2^precision), 0.8% at 14. A sketch has a bounded
    size, so a campaign with most of the traffic is merged from partial sketches.
    """
    kind = F.col("event_type")
    marked = ((VIEWED, "session_id"), (IN_CART, "session_id"), (CHECKED_OUT, "session_id"), (VIEWED, "customer_id"))
    return _campaign_events(events).groupBy("event_date", "campaign_id").agg(*[
        F.hll_sketch_agg(F.when(kind == step, F.col(who)), F.lit(precision)).alias(name) for name, (step, who) in zip(SKETCHES, marked)
    ])


def united_estimates(sketches: DataFrame, *by: str) -> DataFrame:
    """Distinct counts over all rows of each group of stored sketches; the events are not read."""
    return sketches.groupBy(*by).agg(*[
        F.hll_sketch_estimate(F.hll_union_agg(name)).alias(name) for name in SKETCHES
    ])


def daily_spend(spend: DataFrame) -> DataFrame:
    daily = spend.groupBy(F.col("spend_date").alias("event_date"), "campaign_id")
    return daily.agg(total(F.sum("amount")).alias("campaign_spend"))


def funnel_keys(metrics: DataFrame, spend: DataFrame) -> DataFrame:
    """Days and campaigns that have events, spend, or both."""
    key = ["event_date", "campaign_id"]
    return metrics.select(*key).union(spend.select(*key)).distinct()


FUNNEL_COUNTS = ("viewing_sessions", "cart_sessions", "checkout_sessions", "viewing_users")


def funnel_from_parts(metrics: DataFrame, spend: DataFrame, campaigns: DataFrame) -> DataFrame:
    """The funnel from per-day metrics and spend.

    Stacking both parts and adding them up gives the key union and the zero defaults in one
    shuffle of rows that are aggregated already; each part is computed once.
    """
    zero = F.lit(0).cast("long")
    stacked = metrics.withColumn("campaign_spend", total(F.lit(0))).unionByName(
        spend.withColumns({name: zero for name in FUNNEL_COUNTS})
    )
    sums = [F.sum(name).alias(name) for name in FUNNEL_COUNTS]
    keyed = stacked.groupBy("event_date", "campaign_id").agg(
        *sums, total(F.sum("campaign_spend")).alias("campaign_spend")
    )
    named = campaigns.select("campaign_id", F.col("name").alias("campaign_name"), "channel")
    return left_join_defaults(keyed, named, ["campaign_id"]).select(
        "event_date",
        "campaign_id",
        "campaign_name",
        "channel",
        *FUNNEL_COUNTS,
        "campaign_spend",
        guarded_ratio("checkout_sessions", "viewing_sessions").alias("session_conversion_rate"),
    )


def mart_conversion_funnel(raw: Mapping[str, DataFrame]) -> DataFrame:
    """Sessions per funnel step, viewing users and spend per day and campaign."""
    return funnel_from_parts(
        campaign_event_metrics(staging(raw, "events")),
        daily_spend(staging(raw, "campaign_spend")),
        staging(raw, "marketing_campaigns"),
    )


def stamped(mart: DataFrame, name: str, published_at: Column) -> DataFrame:
    """A mart in its serving contract: column order, types and the build time."""
    contract = MARTS[name]
    timed = mart.withColumn("published_at", published_at)
    return timed.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in contract.fields])


def daily_net_revenue(revenue: DataFrame) -> DataFrame:
    """The dashboard series: net revenue per day and currency."""
    return revenue.groupBy("order_date", "currency").agg(total(F.sum("net_revenue")).alias("net_revenue"))
