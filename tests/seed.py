"""The small seed set with known answers. All values are fixed values."""

from __future__ import annotations

from datetime import UTC, date, datetime, timedelta
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import RAW_TABLES
from tidemark.sources.raw import typed_revisions
from tidemark.sources.windows import moment

START = datetime(2026, 1, 1, 9, tzinfo=UTC)


def at(days: int = 0, hours: int = 0, minutes: int = 0) -> datetime:
    return START + timedelta(days=days, hours=hours, minutes=minutes)


def money(value: int) -> Decimal:
    return Decimal(value).quantize(Decimal("0.01"))


def _steps(number: int, session: str, campaign: str, customer: str, day: int, steps: str) -> list[tuple]:
    delays = {"view": ("product_viewed", 0), "cart": ("add_to_cart", 2), "checkout": ("checkout_completed", 5)}
    rows = []
    for step in steps.split():
        kind, delay = delays[step]
        when = at(day, minutes=number + delay)
        rows.append((f"evt_{number}_{step}", kind, session, customer, "prod_001", campaign, when, when, False))
    return rows


ROWS: dict[str, list[tuple]] = {
    "customers": [
        ("cus_001", "an@example.test", "VN", at(-30), at(), False),
        ("cus_002", "binh@example.test", "VN", at(-20), at(), False),
        ("cus_003", "chris@example.test", None, at(-10), at(), False),
    ],
    "orders": [
        ("ord_001", "cus_001", "completed", "USD", at(), at(0, 1), False),
        ("ord_002", "cus_002", "completed", "USD", at(1), at(1, 2), False),
        ("ord_003", "cus_001", "cancelled", "USD", at(2), at(2, 1), False),
    ],
    "order_items": [
        ("item_001", "ord_001", "prod_001", 2, money(50), at(0, 1), False),
        ("item_002", "ord_002", "prod_002", 1, money(80), at(1, 2), False),
        ("item_003", "ord_003", "prod_003", 1, money(40), at(2, 1), False),
    ],
    "payments": [
        ("pay_001", "ord_001", "txn_001", "succeeded", money(100), at(0, 2), at(0, 2), False),
        ("pay_002", "ord_002", "txn_002", "succeeded", money(80), at(1, 8), at(1, 8), False),
        ("pay_003", "ord_003", "txn_003", "failed", money(40), None, at(2, 2), False),
    ],
    "refunds": [("ref_001", "pay_001", "succeeded", money(20), at(2), at(2), False)],
    "events": [
        *_steps(0, "sess_001", "cmp_001", "cus_001", 0, "view cart checkout"),
        *_steps(1, "sess_002", "cmp_001", "cus_002", 0, "view cart"),
        *_steps(2, "sess_003", "cmp_002", "cus_002", 1, "view cart checkout"),
    ],
    "marketing_campaigns": [
        ("cmp_001", "New Year Search", "search", at(-5), at(10), at(), False),
        ("cmp_002", "Retargeting", "social", at(-3), None, at(), False),
    ],
    "campaign_spend": [
        ("spend_001", "cmp_001", date(2026, 1, 1), money(25), at(0, 3), False),
        ("spend_002", "cmp_002", date(2026, 1, 2), money(15), at(1, 3), False),
    ],
    "product_catalog": [
        ("prod_001", "Everyday Sneakers", "footwear", Decimal("22.50"), at(), False),
    ],
}

LATE_REFUND = ("ref_late_002", "pay_002", "succeeded", money(10), at(3), at(3), False)


def source(spark: SparkSession, table: str, rows: list[tuple] | None = None) -> DataFrame:
    """A source table as the extract sees it."""
    return spark.createDataFrame(ROWS[table] if rows is None else rows, RAW_TABLES[table].business)


def sources(spark: SparkSession, names=tuple(ROWS)) -> dict[str, DataFrame]:
    return {name: source(spark, name) for name in names}


def raw(spark: SparkSession, **changes: list[tuple]) -> dict[str, DataFrame]:
    """The raw tables after loading the seed; ``changes`` adds rows in a second batch."""
    tables = {}
    for name in ROWS:
        parts = [(ROWS[name], "batch-1"), (changes.get(name, []), "batch-2")]
        logs = [
            typed_revisions(source(spark, name, rows), RAW_TABLES[name], batch, moment(at(5)))
            for rows, batch in parts
            if rows
        ]
        tables[name] = logs[0] if len(logs) == 1 else logs[0].unionByName(logs[1])
    return tables


def values(df: DataFrame, *columns: str) -> list[tuple]:
    return sorted(tuple(str(v) for v in row) for row in df.select(*[F.col(c) for c in columns]).collect())
