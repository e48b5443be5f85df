"""Generic records read as variants, with fields and types found in the log itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def found_schema(records: DataFrame, table: str) -> T.StructType:
    """The fields of all records of one table and the types that hold all their values.

    One aggregate over the whole log, merged from partial results, so a field that appears late is
    found. Numbers of several kinds widen; values that share no type stay variants; a field that is
    always null is text. No records give no fields.
    """
    log = records.where(F.col("table_name") == table).select(F.parse_json("record_json").alias("v"))
    text = log.agg(F.schema_of_variant_agg("v")).first()[0]
    if not text.startswith("OBJECT<"):
        return T.StructType([])
    inner = text[len("OBJECT<"):-1].replace("OBJECT<", "STRUCT<").replace(": VOID", ": STRING")
    return T.StructType.fromDDL(inner)


def generic_variant(records: DataFrame, table: str, schema: T.StructType | None = None) -> DataFrame:
    """The records of one table as columns, taken out of variants.

    A field that a record lacks is null; so is one whose value does not have the column's type, which
    cannot happen with the found schema.
    """
    fields = found_schema(records, table) if schema is None else schema
    rows = records.where(F.col("table_name") == table).select(F.parse_json("record_json").alias("v"))
    return rows.select(*[
        F.try_variant_get("v", f"$['{field.name}']", field.dataType.simpleString()).alias(field.name) for field in fields.fields
    ])
