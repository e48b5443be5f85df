"""Known answers on the seed set."""

import seed

from tidemark.plans import commerce
from tidemark.operators import quality


def test_order_finance(spark):
    core = commerce.core_order_financial(seed.raw(spark))
    assert seed.values(core, "order_id", "gross_amount", "paid_amount", "refunded_amount", "net_amount") == [
        ("ord_001", "100.00", "100.00", "20.00", "80.00"),
        ("ord_002", "80.00", "80.00", "0.00", "80.00"),
        ("ord_003", "40.00", "0.00", "0.00", "0.00"),
    ]


def revenue(spark, **changes):
    mart = commerce.mart_daily_revenue(commerce.core_order_financial(seed.raw(spark, **changes)))
    return seed.values(
        mart, "grain_key", "paid_orders", "gross_order_value", "captured_revenue", "refunded_revenue", "net_revenue"
    )


FIRST = ("2026-01-01:USD", "1", "100.00", "100.00", "20.00", "80.00")


def test_daily_revenue_and_late_refund(spark):
    assert revenue(spark) == [FIRST, ("2026-01-02:USD", "1", "80.00", "80.00", "0.00", "80.00")]
    # The late refund lands on the day of its order and moves nothing else.
    assert revenue(spark, refunds=[seed.LATE_REFUND]) == [
        FIRST, ("2026-01-02:USD", "1", "80.00", "80.00", "10.00", "70.00")
    ]


def test_funnel(spark):
    mart = commerce.mart_conversion_funnel(seed.raw(spark))
    columns = mart.columns
    assert columns[2:4] == ["campaign_name", "channel"]
    assert seed.values(mart, *columns) == [
        ("2026-01-01", "cmp_001", "New Year Search", "search", "2", "2", "1", "2", "25.00", "0.5"),
        ("2026-01-02", "cmp_002", "Retargeting", "social", "1", "1", "1", "1", "15.00", "1.0"),
    ]


def test_funnel_defaults(spark):
    """Spend without events gives zeros; an unknown campaign gives empty names, never NULL."""
    spend = [("spend_9", "cmp_404", seed.date(2026, 1, 9), seed.money(5), seed.at(8), False)]
    mart = commerce.mart_conversion_funnel(seed.raw(spark, campaign_spend=spend))
    assert seed.values(mart.where("campaign_id = 'cmp_404'"), *mart.columns) == [
        ("2026-01-09", "cmp_404", "", "", "0", "0", "0", "0", "5.00", "0.0")
    ]


def test_customer_orders_drop_deleted_customers(spark):
    gone = [("cus_002", "binh@example.test", "VN", seed.at(-20), seed.at(4), True)]
    raw = seed.raw(spark, customers=gone)
    mart = commerce.mart_customer_orders(commerce.core_order_financial(raw), commerce.staging(raw, "customers"))
    assert seed.values(mart, "order_id", "customer_email") == [
        ("ord_001", "an@example.test"), ("ord_003", "an@example.test")
    ]


def test_orphan_refunds_break_the_reconciliation(spark):
    orphan = ("ref_x", "pay_404", "succeeded", seed.money(7), seed.at(3), seed.at(3), False)
    for changes, good in (({}, True), ({"refunds": [orphan]}, False)):
        raw = seed.raw(spark, **changes)
        mart = commerce.mart_daily_revenue(commerce.core_order_financial(raw))
        live = [commerce.staging(raw, name) for name in ("payments", "refunds")]
        assert quality.reconcile_net(mart, *live).first().reconciled is good


def test_marts_pass_their_tests(spark):
    raw = seed.raw(spark)
    core = commerce.core_order_financial(raw)
    tests = quality.mart_tests(
        commerce.mart_daily_revenue(core),
        commerce.mart_conversion_funnel(raw),
        commerce.mart_customer_orders(core, commerce.staging(raw, "customers")),
    )
    assert tests.count() == 12
    assert tests.where("violations > 0").count() == 0


def test_a_revised_payment_counts_once(spark):
    again = ("pay_001", "ord_001", "txn_001", "succeeded", seed.money(10), seed.at(0), seed.at(9), False)
    raw = seed.raw(spark, payments=[again])
    live = commerce.staging(raw, "payments")
    standing = quality.source_net(live, commerce.staging(raw, "refunds")).first().source_net
    mart = commerce.mart_daily_revenue(commerce.core_order_financial(raw))
    assert quality.reconcile_net(mart, live, commerce.staging(raw, "refunds")).first().reconciled
    assert quality.source_net(raw["payments"], commerce.staging(raw, "refunds")).first().source_net > standing
