"""Type registry of the change feed: OID -> Spark type, text -> value, value -> text, and which widenings are allowed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Type OIDs of the change feed.
BOOL, BYTEA, INT8, INT2, INT4, TEXT, JSON = 16, 17, 20, 21, 23, 25, 114
FLOAT4, FLOAT8, VARCHAR, DATE, TIMESTAMP, TIMESTAMPTZ, NUMERIC, UUID, JSONB = 700, 701, 1043, 1082, 1114, 1184, 1700, 2950, 3802

SPARK_TYPES: dict[int, T.DataType] = {
    BOOL: T.BooleanType(), INT2: T.IntegerType(), INT4: T.IntegerType(), INT8: T.LongType(), FLOAT4: T.FloatType(), FLOAT8: T.DoubleType(),
    DATE: T.DateType(), TIMESTAMP: T.TimestampNTZType(), TIMESTAMPTZ: T.TimestampType(), BYTEA: T.BinaryType(),
}
#: OIDs that a client of the query side sees, by Spark type; everything else goes out as text.
WIRE_OIDS = {"boolean": BOOL, "smallint": INT2, "int": INT4, "bigint": INT8, "float": FLOAT4, "double": FLOAT8, "date": DATE, "timestamp_ntz": TIMESTAMP, "timestamp": TIMESTAMPTZ, "binary": BYTEA}
WIDENINGS = {("int", "bigint"), ("float", "double")}


def spark_type(oid: int, typmod: int = -1, decimals: bool = False) -> T.DataType:
    """``decimals`` maps constrained numerics to decimals; else they stay text."""
    if oid == NUMERIC and decimals:
        if typmod < 4:
            return T.DecimalType(38, 18)
        precision, scale = (typmod - 4) >> 16 & 0xFFFF, (typmod - 4) & 0x7FF
        return T.DecimalType(min(precision, 38), min(scale, 38)) if precision <= 38 else T.StringType()
    return SPARK_TYPES.get(oid, T.StringType())


def wire_oid(kind: T.DataType) -> int:
    return WIRE_OIDS.get(kind.simpleString(), TEXT)


def parse(text: Column, oid: int) -> Column:
    """Typed value of a text cell; null for null and for text that the type has no value for."""
    if oid == BOOL:
        return F.when(text.isin("t", "true", "TRUE"), True).when(text.isin("f", "false", "FALSE"), False)
    if oid == DATE:
        return F.when(text.rlike(r"^\d{4,}-\d\d-\d\d$"), text.try_cast("date"))
    if oid == TIMESTAMP:
        return F.when(text.rlike(r"^\d{4,}-\d\d-\d\d[ T]\d\d:\d\d:\d\d(\.\d{1,9})?$"), text.try_cast("timestamp_ntz"))
    if oid == TIMESTAMPTZ:
        return F.when(text.rlike(r"^\d{4,}-\d\d-\d\d[ T]\d\d:\d\d:\d\d(\.\d{1,9})?([+-]\d\d(:?\d\d)?(:\d\d)?|Z)?$"), text.try_cast("timestamp"))
    if oid == BYTEA:
        return F.when(text.startswith("\\x"), F.unhex(F.substring(text, 3, 1 << 30)))
    if oid in (FLOAT4, FLOAT8):
        return text.try_cast(SPARK_TYPES[oid])
    if oid in (INT2, INT4, INT8):
        return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast(SPARK_TYPES[oid]))
    return text


def render(value: Column, oid: int) -> Column:
    """Text of a typed value; inverse of ``parse``."""
    if oid == BOOL:
        return F.when(value, "t").when(~value, "f")
    if oid == DATE:
        return F.date_format(value, "yyyy-MM-dd")
    if oid == TIMESTAMP:
        return value.cast("string")
    if oid == TIMESTAMPTZ:
        return F.concat(value.cast("string"), F.lit("+00"))
    if oid == BYTEA:
        return F.concat(F.lit("\\x"), F.lower(F.hex(value)))
    return value.cast("string")


def can_widen(old: T.DataType, new: T.DataType) -> bool:
    pair = (old.simpleString(), new.simpleString())
    return pair[0] == pair[1] or pair in WIDENINGS


def lsn_to_bigint(text: Column) -> Column:
    """``hi/lo`` in hex to a number."""
    parts = F.split(text, "/")
    return F.conv(parts[0], 16, 10).cast("bigint") * F.lit(1 << 32) + F.conv(parts[1], 16, 10).cast("bigint")


def bigint_to_lsn(lsn: Column) -> Column:
    return F.concat(F.hex(F.shiftrightunsigned(lsn, 32)), F.lit("/"), F.hex(lsn.bitwiseAND(F.lit(0xFFFFFFFF))))


def parse_lsn(text: str) -> int:
    hi, _, lo = text.partition("/")
    return int(hi, 16) << 32 | int(lo, 16)


def format_lsn(lsn: int) -> str:
    return f"{lsn >> 32:X}/{lsn & 0xFFFFFFFF:X}"


def quote_ident(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def quote_literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"
