"""Column expressions shared by the operators. All are built-in functions and stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schemas import MONEY, TOTAL


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def total(value: Column | str) -> Column:
    """A money output at the serving width."""
    return col(value).cast(TOTAL)


def total_or_zero(value: Column | str) -> Column:
    return F.coalesce(total(value), F.lit(0).cast(TOTAL))


def sum_if(condition: Column, value: Column | str) -> Column:
    """Conditional sum that is 0, not NULL, for a group in which no row matches."""
    return total(F.sum(F.when(condition, col(value)).otherwise(F.lit(0).cast(MONEY))))


def count_distinct_if(condition: Column, value: Column | str) -> Column:
    return F.count_distinct(F.when(condition, col(value)))


def guarded_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Float division that gives 0.0 for a zero denominator."""
    bottom = col(denominator)
    return F.when(bottom == 0, F.lit(0.0)).otherwise(col(numerator).cast("double") / bottom)


def grain_key(day: Column | str, currency: Column | str) -> Column:
    return F.concat(col(day).cast("string"), F.lit(":"), col(currency))


def utc_day(moment: Column | str) -> Column:
    """The UTC day of a timestamp, whatever the zone of the session."""
    return F.date_from_unix_date(F.floor(F.unix_micros(col(moment)) / F.lit(86_400_000_000)).cast("int"))


def utc_text(moment: Column | str) -> Column:
    """A timestamp as UTC text, whatever the zone of the session."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(col(moment)), F.lit("1970-01-01").cast("timestamp_ntz")).cast("string")


def year_month(moment: Column | str) -> Column:
    return F.date_format(utc_day(moment), "yyyyMM")


def to_millis(moment: Column | str) -> Column:
    return F.date_trunc("millisecond", col(moment))


def build_time() -> Column:
    """One timestamp per query at millisecond precision."""
    return to_millis(F.current_timestamp())


def age_seconds(as_of: Column, moment: Column | str) -> Column:
    """Seconds between two timestamps as a double."""
    return (F.unix_micros(as_of) - F.unix_micros(col(moment))) / F.lit(1e6)


def parse_timestamp(text: Column | str) -> Column:
    """ISO-8601 text, with an offset or a ``Z``; NULL when it is not a timestamp."""
    return col(text).try_cast("timestamp")


def parse_money(text: Column | str) -> Column:
    """Decimal text; NULL when it is not a number."""
    return col(text).try_cast(MONEY)


def truthy(text: Column | str) -> Column:
    return F.lower(F.coalesce(col(text), F.lit("false"))) == "true"


def default_for(kind: T.DataType) -> Column:
    """The value an unmatched, non-nullable column takes in a default-filling join."""
    if isinstance(kind, T.StringType):
        return F.lit("")
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, T.NumericType):
        return F.lit(0).cast(kind)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit("1970-01-01").cast(kind)
    raise TypeError(f"no default for {kind.simpleString()}")


def _field_text(name: str, kind: T.DataType) -> Column:
    value = F.col(f"`{name}`")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value).cast("string")
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.to_json(value)
    if isinstance(kind, T.BinaryType):
        return F.hex(value)
    return value.cast("string")


def row_text(df: DataFrame, columns: Sequence[str]) -> Column:
    """One string per row in which two different rows never read the same.

    Every value carries its length and NULL has a mark of its own, so neither separators inside
    values nor NULLs next to each other can make rows collide.
    """
    parts = []
    for name in columns:
        text = _field_text(name, df.schema[name].dataType)
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.concat(*parts)


def hash_slice(hex_digest: Column | str, index: int = 0) -> Column:
    """Fifteen hex digits (60 bits) of a digest as an exact number that can be summed.

    A SHA-256 digest has five slices; the last holds the remaining four digits.
    """
    return _slice_value(hex_digest, index).cast(T.DecimalType(20, 0))


def _slice_value(hex_digest: Column | str, index: int) -> Column:
    piece = F.substring(col(hex_digest), 1 + 15 * index, 15)
    return F.conv(piece, 16, 10).cast("long")


_PIECE_BITS = 20


def slice_sum(hex_digest: Column | str, index: int = 0) -> Column:
    """The sum of ``hash_slice`` over a group, 0 for no rows.

    Adding decimals row by row costs more than the hash, so pieces of 20 bits are added as long numbers, which
    2^43 rows cannot overflow, and put together once a group.
    """
    value = _slice_value(hex_digest, index)
    low_bits = F.lit((1 << _PIECE_BITS) - 1)
    out = F.lit(0).cast(T.DecimalType(38, 0))
    for place in (0, 1, 2):
        piece = F.shiftright(value, _PIECE_BITS * place).bitwiseAND(low_bits)
        added = F.coalesce(F.sum(piece), F.lit(0)).cast(T.DecimalType(19, 0))
        out = out + added * F.lit(1 << (_PIECE_BITS * place)).cast(T.DecimalType(13, 0))
    return out.cast(T.DecimalType(38, 0))


def record_hash(df: DataFrame, columns: Sequence[str]) -> Column:
    """SHA-256 of the compact JSON of the columns as strings, in name order and with NULLs kept.

    Timestamps are written in UTC, so writers in different zones agree.
    """

    def text(name: str) -> Column:
        value = F.col(f"`{name}`")
        return utc_text(value) if isinstance(df.schema[name].dataType, T.TimestampType) else value.cast("string")

    fields = F.struct(*[text(name).alias(name) for name in sorted(columns)])
    options = {"ignoreNullFields": "false", "writeNonAsciiCharacterAsCodePoint": "true"}
    return F.sha2(F.to_json(fields, options), 256)


_DIGEST_DIGITS = 64


def packed_digest(text: Column | str) -> Column:
    """A SHA-256 as bytes that sort as its text does; any other text keeps its place and can be had back.

    Hex digits fill half their bytes, and no fast codec makes up for that, so digests travel packed. A digest
    becomes its 32 bytes and a 1. Other text becomes a digest next to its place, then 0 if the text comes
    before that digest and 2 if it comes after, then itself.
    """
    value = col(text)
    plain = F.when((F.octet_length(value) == _DIGEST_DIGITS) & (F.lower(value) == value), value)
    digest = F.concat(F.unhex(plain), F.lit(b"\x01"))  # NULL when a character is no hex digit
    # What a digest shares with the text decides, up to the first character that no digest has there.
    head = F.regexp_extract(value, f"^[0-9a-f]{{0,{_DIGEST_DIGITS}}}", 0)
    after = F.substring(value, F.length(head) + 1, F.lit(1))
    below = (F.length(head) < _DIGEST_DIGITS) & (after < "0")
    above = (F.length(head) == _DIGEST_DIGITS) | (after > "f")

    def filled(digits: Column, digit: str) -> Column:
        return F.unhex(F.rpad(digits, _DIGEST_DIGITS, digit))

    other = (
        F.when(below, F.concat(filled(head, "0"), F.lit(b"\x00")))
        .when(above, F.concat(filled(head, "f"), F.lit(b"\x02")))
        .otherwise(F.concat(filled(F.concat(head, F.lit("9")), "f"), F.lit(b"\x02")))
    )
    return F.coalesce(digest, F.concat(other, value.cast("binary")))


def unpacked_digest(packed: Column | str) -> Column:
    """The text that ``packed_digest`` was given."""
    value = col(packed)
    size = _DIGEST_DIGITS // 2
    digest = F.lower(F.hex(F.substring(value, 1, size)))
    text = F.substring(value, F.lit(size + 2), F.length(value)).cast("string")
    return F.when(F.substring(value, size + 1, 1) == F.lit(b"\x01"), digest).otherwise(text)


def record_json(columns: Sequence[str]) -> Column:
    """Compact JSON of a record with its fields in name order and NULLs kept."""
    fields = F.struct(*[F.col(f"`{name}`") for name in sorted(columns)])
    return F.to_json(fields, {"ignoreNullFields": "false", "timeZone": "UTC"})
