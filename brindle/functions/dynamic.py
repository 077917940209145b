"""Dynamic mode: predicates, projections and sort keys on VARIANT values.

A path into a VARIANT column needs no schema: a field may be missing, null or of
another type in each row. Missing is a null column, null is a variant that holds
null, and values of different types are ordered by their type's rank. Variants
keep no width of whole numbers: ``int`` is what fits 32 bits, and fractions count
as ``double``, also where JSON text makes decimals of them; numbers of different
kinds are compared as doubles.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.errors import InvalidRequest
from brindle.functions.literals import rank_of
from brindle.plans.filters import Compare, ElemMatch, Exists, HasAll, HasSize, HasType, Member
from brindle.plans.projections import Match, Slice

#: What schema_of_variant begins with, by rank of the type.
RANKS = {
    "VOID": 1, "BIGINT": 2, "DOUBLE": 2, "FLOAT": 2, "DECIMAL": 2, "STRING": 3, "OBJECT": 4, "ARRAY": 5,
    "BINARY": 6, "BOOLEAN": 8, "DATE": 9, "TIMESTAMP": 9,
}


def at_path(value: Column, steps: tuple[str, ...]) -> Column:
    """The variant at a path, null where it is missing; a number is a place in an array."""
    if not steps:
        return value
    if any('"' in s for s in steps):
        raise InvalidRequest("Field names in dynamic documents cannot contain quotes")
    path = "$" + "".join(f"[{int(s)}]" if s.isdigit() else f'["{s}"]' for s in steps)
    return F.try_variant_get(value, path, "variant")


def elements(value: Column) -> Column:
    """The elements of an array, null for any other value. A null element stays a value."""
    items = F.try_variant_get(value, "$", "array<variant>")
    return F.transform(items, lambda e: F.coalesce(e, F.parse_json(F.lit("null"))))


def kind_of(value: Column) -> Column:
    """The type's name without its parameters; null where the value is missing."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def rank(value: Column) -> Column:
    kind = kind_of(value)
    listed = [F.when(kind == name, F.lit(place)) for name, place in RANKS.items()]
    return F.when(value.isNotNull(), F.coalesce(*listed, F.lit(10)))


def is_null(value: Column) -> Column:
    return value.isNotNull() & F.is_variant_null(value)


def _sure(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def _scalar(value: Column, other: Any) -> tuple[Column, Column]:
    """Both sides of a comparison of values of one rank."""
    want = rank_of(other)
    get = lambda kind: F.try_variant_get(value, "$", kind)
    if want == 2:
        if isinstance(other, int) and -(2**63) <= other < 2**63:
            # A whole number against a fraction: both as doubles, without losing digits of two whole numbers.
            whole = kind_of(value) == "BIGINT"
            sign = F.when(whole, F.signum((get("bigint") > F.lit(other)).cast("int") - (get("bigint") < F.lit(other)).cast("int")))
            return F.coalesce(sign, get("double") - F.lit(float(other))), F.lit(0.0)
        return get("double"), F.lit(float(other))
    names = {3: "string", 6: "binary", 8: "boolean", 9: "timestamp"}
    return get(names[want]), F.lit(other).cast(names[want])


def same(value: Column, other: Any) -> Column:
    """Two-valued: the value is there and equals ``other`` as a whole."""
    want = rank_of(other)
    if want == 1:
        return _sure(is_null(value))
    if want == 4:
        fields = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
        parts = [F.size(fields) == len(other), *[same(F.try_variant_get(value, f'$["{k}"]', "variant"), v) for k, v in other.items()]]
        return _sure(kind_of(value) == "OBJECT") & _sure(reduce(and_, parts))
    if want == 5:
        items = elements(value)
        return _sure(reduce(and_, [F.size(items) == len(other), *[same(F.get(items, F.lit(i)), v) for i, v in enumerate(other)]]))
    left, right = _scalar(value, other)
    return _sure((rank(value) == want) & (left == right))


def _bound(test: Compare, value: Column) -> Column:
    """eq or a bound on one value, which is no array of candidates."""
    op, other = test.op, test.value
    if op == "eq":
        return same(value, other)
    want = rank_of(other)
    have = rank(value)
    aside = have > want if op in ("gt", "ge") else have < want
    if want == 1:
        return _sure(aside | (have == 1) if op in ("ge", "le") else aside)
    if want in (4, 5):
        raise InvalidRequest("Bounds by documents and arrays need a schema")
    left, right = _scalar(value, other)
    inside = {"gt": left > right, "ge": left >= right, "lt": left < right, "le": left <= right}[op]
    return _sure(aside | ((have == want) & inside))


def compile_variant_tests(tests: tuple, value: Column, element_test: Callable) -> Column:
    """All tests on one variant, two-valued; an array's bounds hold for one of its elements together."""
    bounds = [t for t in tests if isinstance(t, Compare) and t.op != "ne"]
    out = [_test(t, value, element_test) for t in tests if t not in bounds]
    if bounds:
        items = elements(value)
        found = F.exists(items, lambda e: reduce(and_, [_bound(t, e) for t in bounds]))
        alone = reduce(and_, [_bound(t, value) for t in bounds])
        missing = F.lit(all(t.op == "eq" and t.value is None for t in bounds)) & value.isNull()
        out.append(missing | _sure(F.when(items.isNotNull(), found).otherwise(alone)))
    return reduce(and_, out) if out else F.lit(True)


def _test(test, value: Column, element_test: Callable) -> Column:
    items = elements(value)
    match test:
        case Compare("ne", other):
            differs = F.when(items.isNotNull(), F.exists(items, lambda e: ~same(e, other))).otherwise(~same(value, other))
            return value.isNotNull() & _sure(differs) if other is None else value.isNull() | _sure(differs)
        case Member(values, negated):
            inside = reduce(or_, [same(value, v) for v in values], F.lit(False))
            return value.isNotNull() & (~inside if negated else inside)
        case Exists(wanted):
            return value.isNotNull() if wanted else value.isNull()
        case HasType(name, negated):
            fits = _sure(_has_type(value, name))
        case HasSize(size, negated):
            fits = _sure(F.size(items) == size)
        case HasAll(values, negated):
            parts = [_holds(items, v) for v in values]
            fits = _sure(reduce(and_, parts, items.isNotNull()))
        case ElemMatch(body, negated):
            fits = _sure(F.size(items) > 0 if body == () else F.exists(items, lambda e: element_test(body, e)))
        case _:
            raise TypeError(test)
    return ~fits if negated else fits


def _holds(items: Column, other: Any) -> Column:
    return F.exists(items, lambda e: same(e, other))


def _has_type(value: Column, name: str) -> Column:
    kind = kind_of(value)
    if name in ("int", "long"):
        short = F.try_variant_get(value, "$", "bigint").between(-(2**31), 2**31 - 1)
        return (kind == "BIGINT") & (short if name == "int" else ~short)
    names = {
        "number": [k for k, place in RANKS.items() if place == 2], "double": ["DOUBLE", "FLOAT", "DECIMAL"], "string": ["STRING"],
        "object": ["OBJECT"], "array": ["ARRAY"], "binData": ["BINARY"], "bool": ["BOOLEAN"], "date": ["DATE", "TIMESTAMP"], "null": ["VOID"],
    }
    return kind.isin(*names[name]) if name in names else F.lit(False)


def fields(value: Column) -> Column:
    """A document as a map, null for any other value. A null field stays a value."""
    return F.transform_values(F.try_variant_get(value, "$", "map<string,variant>"), lambda _, v: F.coalesce(v, F.parse_json(F.lit("null"))))


def take(column: Column, rule: Slice) -> Column:
    if rule.limit < 0:
        n = -rule.limit
        return F.slice(column, F.greatest(F.size(column) - F.lit(n - 1), F.lit(1)), F.lit(n))
    return F.slice(column, rule.skip + 1, rule.limit)


def keep(value: Column, rule: Any, element_test: Callable) -> Column:
    """What an including projection leaves of a variant; null where nothing is left."""
    if rule is True:
        return value
    if isinstance(rule, Slice):
        return F.to_variant_object(take(elements(value), rule))
    if isinstance(rule, Match):
        return F.to_variant_object(F.filter(elements(value), lambda e: element_test(rule.body, e)))
    parts = [F.struct(F.lit(step).alias("k"), keep(at_path(value, (step,)), rule[step], element_test).alias("v")) for step in sorted(rule)]
    left = F.map_from_entries(F.filter(F.array(*parts), lambda e: e["v"].isNotNull()))
    holders = ["OBJECT", "ARRAY"] if any(step.isdigit() for step in rule) else ["OBJECT"]
    return F.when(kind_of(value).isin(*holders), F.to_variant_object(left))


def drop(value: Column, rule: dict) -> Column:
    """A variant without the fields of an excluding projection, which reaches through documents only."""
    gone = [name for name, inner in rule.items() if inner is True]
    left = fields(value)
    if gone:
        left = F.map_filter(left, lambda k, _: ~k.isin(*gone))
    for name, inner in rule.items():
        if inner is not True:
            left = _changed(left, name, inner)
    return F.when(kind_of(value) == "OBJECT", F.to_variant_object(left)).otherwise(value)


def _changed(left: Column, name: str, rule: dict) -> Column:
    return F.transform_values(left, lambda k, v: F.when(k == name, drop(v, rule)).otherwise(v))


def sort_keys(value: Column) -> list[Column]:
    """Columns that order variants by rank and then by value; missing stands with null.
    Documents and arrays are ordered by their JSON text."""
    place = F.coalesce(rank(value), F.lit(1))
    get = lambda kind: F.try_variant_get(value, "$", kind)
    number = F.when(place == 2, get("double"))
    return [place, F.isnan(number).cast("int") * -1, number, F.when(place.isin(3, 4, 5), get("string")), F.when(place == 6, get("binary")),
            F.when(place == 8, get("boolean")), F.when(place == 9, get("timestamp"))]
