"""Joins with defaults."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import default_for


def left_join_defaults(
    left: DataFrame, right: DataFrame, on: Sequence[str], keep_null: Sequence[str] = ()
) -> DataFrame:
    """Left equi-join in which unmatched right columns take their type's default.

    Columns named in ``keep_null`` are nullable by contract and stay NULL. The join strategy is
    left to Spark, which broadcasts ``right`` only when its measured size is small.
    """
    filled = [
        F.coalesce(F.col(f.name), default_for(f.dataType)).alias(f.name) if f.name not in keep_null else F.col(f.name)
        for f in right.schema.fields
        if f.name not in on
    ]
    return left.join(right, list(on), "left").select(*left.columns, *filled)
