"""Python values as Spark types and columns, and the language's ranks of types."""

from __future__ import annotations

import datetime as dt
import decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.errors import InvalidRequest

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
FLOATS = (T.FloatType, T.DoubleType)
INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def rank_of_type(kind: T.DataType) -> int:
    """Place of a type in the order of all values: null < numbers < strings < documents < arrays < …"""
    groups = (
        (1, T.NullType), (2, NUMBERS), (3, T.StringType), (4, (T.StructType, T.MapType)), (5, T.ArrayType),
        (6, T.BinaryType), (8, T.BooleanType), (9, (T.TimestampType, T.TimestampNTZType, T.DateType)),
    )
    for rank, types in groups:
        if isinstance(kind, types):
            return rank
    return 10


def rank_of(value: Any) -> int:
    if value is None:
        return 1
    if isinstance(value, bool):
        return 8
    for rank, types in ((2, (int, float, decimal.Decimal)), (3, str), (4, dict), (5, (list, tuple)), (6, (bytes, bytearray)), (9, (dt.date, dt.datetime))):
        if isinstance(value, types):
            return rank
    raise InvalidRequest(f"Unsupported value: {value!r}")


def type_of(value: Any) -> T.DataType:
    """The narrowest column type of a value."""
    rank = rank_of(value)
    if rank == 2:
        if isinstance(value, decimal.Decimal):
            return T.DecimalType(38, max(0, -int(value.as_tuple().exponent)))
        if isinstance(value, float):
            return T.DoubleType()
        return T.IntegerType() if -(2**31) <= value < 2**31 else T.LongType()
    if rank == 4:
        return T.StructType([T.StructField(k, type_of(v)) for k, v in value.items()])
    if rank == 5:
        kind: T.DataType = T.NullType()
        for v in value:
            kind = common_type(kind, type_of(v))
        return T.ArrayType(kind)
    if rank == 9:
        if not isinstance(value, dt.datetime):
            return T.DateType()
        return T.TimestampNTZType() if value.tzinfo is None else T.TimestampType()
    return {1: T.NullType(), 3: T.StringType(), 6: T.BinaryType(), 8: T.BooleanType()}[rank]


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """A type that holds values of both; numbers widen, documents merge their fields."""
    if isinstance(a, T.NullType) or a == b:
        return b
    if isinstance(b, T.NullType):
        return a
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        fields = {f.name: f.dataType for f in a}
        for f in b:
            fields[f.name] = common_type(fields[f.name], f.dataType) if f.name in fields else f.dataType
        return T.StructType([T.StructField(k, v) for k, v in fields.items()])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(common_type(a.elementType, b.elementType))
    if isinstance(a, NUMBERS) and isinstance(b, NUMBERS):
        if isinstance(a, FLOATS) or isinstance(b, FLOATS):
            return T.DoubleType()
        if isinstance(a, T.DecimalType) or isinstance(b, T.DecimalType):
            return T.DecimalType(38, max(getattr(a, "scale", 0), getattr(b, "scale", 0)))
        return T.LongType() if T.LongType() in (a, b) else T.IntegerType()
    raise InvalidRequest(f"Values of {a.simpleString()} and {b.simpleString()} do not fit one column")


def literal(value: Any, kind: T.DataType | None = None) -> Column:
    """A constant column of type ``kind`` (default: the value's own)."""
    kind = kind or type_of(value)
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.StructType):
        if not isinstance(value, dict):
            raise InvalidRequest(f"A document is needed, not {value!r}")
        extra = set(value) - set(kind.names)
        if extra:
            raise InvalidRequest(f"Unknown fields: {sorted(extra)}")
        return F.struct(*[literal(value.get(f.name), f.dataType).alias(f.name) for f in kind])
    if isinstance(kind, T.ArrayType):
        if not isinstance(value, list | tuple):
            raise InvalidRequest(f"An array is needed, not {value!r}")
        return F.array(*[literal(v, kind.elementType) for v in value]).cast(kind)
    if rank_of(value) != rank_of_type(kind):
        raise InvalidRequest(f"{value!r} does not fit a column of {kind.simpleString()}")
    return F.lit(value).cast(kind)


def same_value(column: Column, kind: T.DataType, value: Any) -> Column | None:
    """``column`` equals ``value`` (null if the column is null); None if their types can never be equal."""
    if rank_of(value) != rank_of_type(kind):
        return None
    if isinstance(kind, T.StructType):
        if set(value) - set(kind.names):
            return None
        out = F.lit(True)
        for f in kind:
            inner = column.getField(f.name)
            if value.get(f.name) is None:
                out = out & inner.isNull()
            else:
                part = same_value(inner, f.dataType, value[f.name])
                if part is None:
                    return None
                out = out & F.coalesce(part, F.lit(False))
        return F.when(column.isNotNull(), out)
    if isinstance(kind, T.ArrayType):
        out = F.size(column) == len(value)
        for i, v in enumerate(value):
            item = F.get(column, F.lit(i))
            part = item.isNull() if v is None else same_value(item, kind.elementType, v)
            if part is None:
                return None
            out = out & F.coalesce(part, F.lit(False))
        return out
    return column == F.lit(value)
