"""Contract projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import to_millis
from tidemark.schemas import AUDIT


def business_columns(df: DataFrame) -> list[str]:
    """The columns of a raw table without its audit columns."""
    return [name for name in df.columns if name not in AUDIT.names]


def with_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose text starts with a prefix, such as the snapshots of one mart by name."""
    return df.where(F.col(column).startswith(prefix))


def _coerced(name: str, kind: T.DataType) -> Column:
    value = F.col(f"`{name}`").cast(kind)
    return to_millis(value) if isinstance(kind, T.TimestampType) else value


def contract_projection(df: DataFrame, contract: T.StructType) -> DataFrame:
    """The contract's columns in its order and types.

    Columns the contract does not know are dropped and missing ones are NULL. A value that cannot
    be converted raises, and so does a NULL in a column that does not allow it.
    """
    present = set(df.columns)
    out = []
    for field in contract.fields:
        if field.name not in present:
            if not field.nullable:
                raise ValueError(f"required column is missing: {field.name}")
            out.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        value = _coerced(field.name, field.dataType)
        if not field.nullable:
            value = F.coalesce(value, F.raise_error(F.lit(f"{field.name} is required")).cast(field.dataType))
        out.append(value.alias(field.name))
    return df.select(*out)


def schema_differences(df: DataFrame, contract: T.StructType) -> list[str]:
    """How a schema departs from a contract in names, order or types; empty when it does not."""
    found = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    wanted = [(f.name, f.dataType.simpleString()) for f in contract.fields]
    problems = [f"missing {n} {t}" for n, t in wanted if (n, t) not in found]
    problems += [f"unexpected {n} {t}" for n, t in found if (n, t) not in wanted]
    if not problems and found != wanted:
        problems.append("column order differs")
    return problems


def keyset_page(
    df: DataFrame,
    key: str,
    size: int,
    after: str | None = None,
    updated_since: Column | None = None,
) -> DataFrame:
    """One page in key order: the rows after ``after``, at most ``size`` of them."""
    if after is not None:
        df = df.where(F.col(key) > after)
    if updated_since is not None:
        df = df.where(F.col("updated_at") >= updated_since)
    return df.orderBy(key).limit(size)


def next_cursor(page: DataFrame, key: str, size: int) -> DataFrame:
    """The key to continue after, or NULL when the page was not full."""
    return page.agg(F.when(F.count(F.lit(1)) == size, F.max(key)).alias("next_cursor"))


def listing(df: DataFrame, columns: Sequence[str], order: Sequence[str], rows: int = 1000) -> DataFrame:
    """The first ``rows`` rows in a fixed order, for a detail table in a dashboard."""
    return df.orderBy(*order).select(*columns).limit(rows)
