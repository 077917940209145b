"""Update operators as columns: a fold over the columns of a row.

Each step turns the current column of its top-level field into the next one, so
later operators see what earlier ones did. Null is a missing field; struct
fields and columns that a step needs are added to the schema.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.errors import InvalidRequest
from brindle.functions.literals import FLOATS, INTEGERS, NUMBERS, common_type, literal, rank_of, rank_of_type, same_value, type_of
from brindle.functions.predicates import Scope, compile_filter, element_test
from brindle.plans.filters import parse_filter
from brindle.plans.updates import Push, Step, Update

Typed = tuple[Column, T.DataType]
#: Operators that do nothing where the field is missing.
QUIET = {"$unset", "$pop", "$pull", "$pullAll"}


def apply_update(df: DataFrame, update: Update, filter: dict | Column | None = None, key: str = "_id", inserting: bool = False) -> DataFrame:
    """``df`` with the rows that ``filter`` selects changed. One projection: no shuffle, no UDF."""
    scope = Scope.of_frame(df, key)
    chosen = filter if isinstance(filter, Column) else compile_filter(parse_filter(filter or {}), scope, bare=False)
    state: dict[str, Typed] = {f.name: (scope.column(f.name), f.dataType) for f in df.schema}
    touched: set[str] = set()
    for step in update.steps:
        if step.op == "$setOnInsert" and not inserting:
            continue
        if key in (step.path[0], step.arg[0] if step.op == "$rename" else None):
            raise InvalidRequest("The key cannot be changed")
        if step.op == "$rename":
            _rename(state, touched, step)
        else:
            _put(state, step.path, lambda c, k, s=step: _leaf(s, c, k), update.filters, step.op not in QUIET)
            touched.add(step.path[0])
    out = []
    for name, (column, kind) in state.items():
        if name in touched:
            old = scope.column(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
            if name in df.columns and _reshaped(df.schema[name].dataType, kind):
                old = fit(scope.column(name), df.schema[name].dataType, kind)
            column = F.when(chosen, column).otherwise(old)
        out.append(column.alias(name))
    return df.select(*out)


def _reshaped(a: T.DataType, b: T.DataType) -> bool:
    return a != b and not (isinstance(a, NUMBERS) and isinstance(b, NUMBERS))


def fit(column: Column, have: T.DataType, want: T.DataType) -> Column:
    """A value in a type that holds more: by field name, with nulls for new fields."""
    if have == want:
        return column
    if isinstance(have, T.StructType) and isinstance(want, T.StructType):
        parts = [
            (fit(column.getField(f.name), have[f.name].dataType, f.dataType) if f.name in have.names else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in want
        ]
        return F.when(column.isNotNull(), F.struct(*parts))
    if isinstance(have, T.ArrayType) and isinstance(want, T.ArrayType):
        return F.transform(column, lambda e: fit(e, have.elementType, want.elementType))
    return column.cast(want)


def _put(state: dict[str, Typed], path: tuple[str, ...], leaf: Callable, filters: dict, create: bool) -> None:
    name = path[0]
    column, kind = state.get(name, (F.lit(None), T.NullType()))
    if name not in state and not create:
        return
    state[name] = _rewrite(column, kind, path[1:], leaf, filters, create)


def _rewrite(column: Column, kind: T.DataType, path: tuple[str, ...], leaf: Callable, filters: dict, create: bool) -> Typed:
    if not path:
        return leaf(column, kind)
    step, rest = path[0], path[1:]
    if step.startswith("$["):
        if not isinstance(kind, T.ArrayType):
            if isinstance(kind, T.NullType):
                return column, kind
            raise InvalidRequest(f"{step} needs an array")
        inner = kind.elementType
        target = _rewrite(F.lit(None).cast(inner), inner, rest, leaf, filters, create)[1]

        def each(e: Column) -> Column:
            new = fit(*_rewrite(e, inner, rest, leaf, filters, create), target)
            return new if step == "$[]" else F.when(element_test(filters[step[2:-1]], e, inner), new).otherwise(fit(e, inner, target))

        return F.transform(column, each), T.ArrayType(target)
    if step.isdigit() and isinstance(kind, T.ArrayType | T.NullType):
        return _at_index(column, kind, int(step), rest, leaf, filters, create)
    if isinstance(kind, T.NullType):
        kind = T.StructType([])
    if not isinstance(kind, T.StructType):
        raise InvalidRequest(f"There is no field {step} in a {kind.simpleString()}")
    if step not in kind.names and not create:
        return column, kind
    present = bool(kind.names)
    old = (column.getField(step), kind[step].dataType) if step in kind.names else (F.lit(None), T.NullType())
    new, new_kind = _rewrite(*old, rest, leaf, filters, create)
    fields = [(f.name, column.getField(f.name), f.dataType) for f in kind if f.name != step]
    at = kind.names.index(step) if step in kind.names else len(fields)
    fields.insert(at, (step, new, new_kind))
    made = F.struct(*[c.alias(n) for n, c, _ in fields])
    out_kind = T.StructType([T.StructField(n, k) for n, _, k in fields])
    if not create and present:
        made = F.when(column.isNotNull(), made)
    return made, out_kind


def _at_index(column: Column, kind: T.DataType, index: int, rest, leaf, filters, create: bool) -> Typed:
    if isinstance(kind, T.NullType):
        if not create:
            return column, kind
        kind, column = T.ArrayType(T.NullType()), F.lit(None)
    inner = kind.elementType
    old = F.get(column, F.lit(index)) if not isinstance(inner, T.NullType) else F.lit(None)
    new, target = _rewrite(old, inner, rest, leaf, filters, create)
    array = T.ArrayType(target)
    whole = fit(column, kind, array) if not isinstance(inner, T.NullType) else F.lit(None).cast(array)
    inside = F.transform(whole, lambda e, i: F.when(i == index, new).otherwise(e))
    if not create:
        return inside, array
    known = F.coalesce(whole, F.array().cast(array))
    pad = F.array_repeat(F.lit(None).cast(target), F.greatest(F.lit(index) - F.size(known), F.lit(0)))
    longer = F.concat(known, pad, F.array(new))
    return F.when(F.size(known) > index, inside).otherwise(longer), array


def _same_class(op: str, value: Any, kind: T.DataType) -> T.DataType:
    """The column's type after it takes ``value``."""
    if value is None:
        return kind
    if isinstance(kind, T.NullType):
        return type_of(value)
    if rank_of(value) != rank_of_type(kind):
        raise InvalidRequest(f"{op}: {value!r} does not fit a column of {kind.simpleString()}")
    if isinstance(kind, NUMBERS):
        return common_type(kind, type_of(value)) if isinstance(value, float) or not isinstance(kind, INTEGERS) else _wide(kind, value)
    return common_type(kind, type_of(value))


def _wide(kind: T.DataType, value: int) -> T.DataType:
    return kind if -(2**31) <= value < 2**31 else T.LongType()


def _leaf(step: Step, column: Column, kind: T.DataType) -> Typed:
    op, arg = step.op, step.arg
    if op in ("$set", "$setOnInsert"):
        new = _same_class(op, arg, kind)
        return literal(arg, new), new
    if op == "$unset":
        return F.lit(None).cast(kind), kind
    if op in ("$inc", "$mul"):
        return _arithmetic(op, arg, column, kind)
    if op in ("$min", "$max"):
        new = _same_class(op, arg, kind)
        value = literal(arg, new)
        if isinstance(kind, T.NullType):
            return value, new
        own = F.coalesce(fit(column, kind, new), value)
        takes = below(value, own, new) if op == "$min" else below(own, value, new)
        return F.when(takes, value).otherwise(own), new
    if op == "$currentDate":
        if arg == "timestamp":
            kind = T._parse_datatype_string("struct<time: int, increment: int>")
            return F.struct(F.unix_timestamp().cast("int").alias("time"), F.lit(0).alias("increment")), kind
        new = kind if rank_of_type(kind) == 9 else T.TimestampType()
        return F.current_timestamp().cast(new), new
    if op == "$bit":
        return _bits(arg, column, kind)
    return _array_step(op, arg, column, kind)


def below(a: Column, b: Column, kind: T.DataType) -> Column:
    """a < b in the order of the language, in which NaN is the least number (Spark's greatest)."""
    if isinstance(kind, FLOATS):
        return ~F.isnan(b) & (F.isnan(a) | (a < b))
    return a < b


def _arithmetic(op: str, arg: Any, column: Column, kind: T.DataType) -> Typed:
    if isinstance(kind, T.NullType):
        new = type_of(arg)
        return literal(arg if op == "$inc" else type(arg)(0), new), new
    if not isinstance(kind, NUMBERS):
        raise InvalidRequest(f"{op} needs a number, not {kind.simpleString()}")
    new = common_type(kind, type_of(arg))
    if isinstance(new, T.IntegerType):
        new = T.LongType()
    value = literal(arg, new)
    zero = F.lit(0).cast(new)
    own = column.cast(new)
    return (F.coalesce(own, zero) + value if op == "$inc" else F.coalesce(own * value, zero)), new


def _bits(arg: dict, column: Column, kind: T.DataType) -> Typed:
    if not isinstance(kind, (*INTEGERS, T.NullType)):
        raise InvalidRequest("$bit needs an integer")
    wide = isinstance(kind, T.LongType) or any(not -(2**31) <= v < 2**31 for v in arg.values())
    new = T.LongType() if wide else T.IntegerType()
    out = F.coalesce(column.cast(new), F.lit(0).cast(new))
    for name, apply in (("and", Column.bitwiseAND), ("or", Column.bitwiseOR), ("xor", Column.bitwiseXOR)):
        if name in arg:
            out = apply(out, F.lit(arg[name]).cast(new))
    return out, new


def _array_step(op: str, arg: Any, column: Column, kind: T.DataType) -> Typed:
    if not isinstance(kind, T.ArrayType | T.NullType):
        raise InvalidRequest(f"{op} needs an array, not {kind.simpleString()}")
    values = arg.values if isinstance(arg, Push) else arg if op in ("$addToSet", "$pullAll") else ()
    if isinstance(kind, T.NullType):
        if op in QUIET:
            return column, kind
        kind, column = T.ArrayType(T.NullType()), None
    inner = kind.elementType
    if op in ("$push", "$addToSet"):
        for v in values:
            inner = _same_class(op, v, inner)
        array = T.ArrayType(inner)
        empty = F.array().cast(array)
        own = empty if column is None else F.coalesce(fit(column, kind, array), empty)
        extra = literal(list(values), array) if values else empty
        if op == "$addToSet":
            return F.concat(own, F.array_except(extra, own)), array
        return _push(arg, own, extra, inner), array
    if op == "$pop":
        n = F.size(column)
        rest = F.slice(column, 1, F.greatest(n - 1, F.lit(0))) if arg == 1 else F.slice(column, 2, F.greatest(n, F.lit(1)))
        return F.when(n > 0, rest).otherwise(column), kind
    if op == "$pullAll":
        return F.filter(column, lambda e: ~_listed(e, inner, values)), kind
    form, body = arg
    if form == "value":
        return F.filter(column, lambda e: ~_listed(e, inner, (body,))), kind
    return F.filter(column, lambda e: ~element_test(body, e, inner)), kind


def _listed(element: Column, kind: T.DataType, values: tuple) -> Column:
    out = F.lit(False)
    for v in values:
        same = element.isNull() if v is None else same_value(element, kind, v)
        if same is not None:
            out = out | F.coalesce(same, F.lit(False))
    return out


def _push(arg: Push, own: Column, extra: Column, inner: T.DataType) -> Column:
    out = F.concat(own, extra)
    if arg.position is not None:
        n = F.size(own)
        at = F.least(F.lit(arg.position), n) if arg.position >= 0 else F.greatest(n + arg.position, F.lit(0))
        out = F.concat(F.slice(own, F.lit(1), at), extra, F.slice(own, at + 1, F.greatest(n - at, F.lit(0))))
    if arg.sort is not None:
        out = _sorted(out, arg.sort, inner)
    if arg.slice is not None:
        n = F.size(out)
        if arg.slice >= 0:
            out = F.slice(out, F.lit(1), F.lit(arg.slice))
        else:
            out = F.slice(out, F.greatest(n + arg.slice, F.lit(0)) + 1, F.lit(-arg.slice))
    return out


def _sorted(column: Column, order: Any, inner: T.DataType) -> Column:
    keys = [((), order)] if isinstance(order, int) else [(tuple(k.split(".")), way) for k, way in order]

    def at(e: Column, path: tuple) -> Typed:
        return Scope.of_value(e, inner).resolve(path) if path else (e, inner)

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for path, way in reversed(keys):
            (x, kind), (y, _) = at(a, path), at(b, path)
            less = F.when(x.isNull() & y.isNotNull(), True).otherwise(F.coalesce(below(x, y, kind), F.lit(False)))
            more = F.when(y.isNull() & x.isNotNull(), True).otherwise(F.coalesce(below(y, x, kind), F.lit(False)))
            out = F.when(less, F.lit(-way)).when(more, F.lit(way)).otherwise(out)
        return out

    return F.array_sort(column, compare)


def _rename(state: dict[str, Typed], touched: set[str], step: Step) -> None:
    source, target = step.path, step.arg
    if source[0] not in state:
        return
    column, kind = state[source[0]]
    for name in source[1:]:
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return
        column, kind = column.getField(name), kind[name].dataType

    def moved(c: Column, k: T.DataType) -> Typed:
        new = common_type(k, kind)
        return F.coalesce(fit(column, kind, new), F.lit(None).cast(new) if isinstance(k, T.NullType) else fit(c, k, new)), new

    _put(state, target, moved, {}, True)
    _put(state, source, lambda c, k: (F.lit(None).cast(k), k), {}, False)
    touched |= {source[0], target[0]}
