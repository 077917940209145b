"""Filter trees compiled to Spark columns.

A scope resolves a path to (column, type) for the root row and for a lambda's
variable alike. Null in a column means that the field is missing; null inside
an array is a value. Below a negation or an Or every leaf is made two-valued;
along the top-level And leaves stay bare, so that Parquet gets the comparisons.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.dynamic import at_path, compile_variant_tests
from brindle.functions.literals import FLOATS, NUMBERS, rank_of, rank_of_type, same_value
from brindle.plans.filters import And, Compare, ElemMatch, Exists, Field, HasAll, HasSize, HasType, Member, Or, parse_filter


class Scope:
    """Where paths start: a row's columns, or one value."""

    def __init__(self, kind: T.StructType, column: Callable[[str], Column], key: str = "_id"):
        self.kind, self.column, self.key = kind, column, key

    @classmethod
    def of_frame(cls, df: DataFrame, key: str = "_id") -> Scope:
        return cls(df.schema, lambda name: F.col("`" + name.replace("`", "``") + "`"), key)

    @classmethod
    def of_value(cls, value: Column, kind: T.DataType) -> Scope:
        if isinstance(kind, T.VariantType):
            return VariantScope(value)
        fields = kind if isinstance(kind, T.StructType) else T.StructType([])
        return cls(fields, value.getField, "")

    def resolve(self, path: tuple[str, ...]) -> tuple[Column, T.DataType]:
        """The column at a path; a null of NullType where the schema has no such place."""
        name = self.key if path[0] == "_id" and "_id" not in self.kind.names and self.key else path[0]
        if name not in self.kind.names:
            return F.lit(None), T.NullType()
        column, kind = self.column(name), self.kind[name].dataType
        for at, step in enumerate(path[1:], 1):
            if isinstance(kind, T.VariantType):
                return at_path(column, path[at:]), kind
            if isinstance(kind, T.StructType) and step in kind.names:
                column, kind = column.getField(step), kind[step].dataType
            elif isinstance(kind, T.ArrayType) and step.isdigit():
                column, kind = F.get(column, F.lit(int(step))), kind.elementType
            elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
                column, kind = F.try_element_at(column, F.lit(step)), kind.valueType
            else:
                return F.lit(None), T.NullType()
        return column, kind


class VariantScope(Scope):
    """Where paths start in one variant."""

    def __init__(self, value: Column):
        super().__init__(T.StructType([]), value.getField, "")
        self.value = value

    def resolve(self, path: tuple[str, ...]) -> tuple[Column, T.DataType]:
        return at_path(self.value, path), T.VariantType()


def compile_filter(node, scope: Scope, bare: bool = True) -> Column:
    match node:
        case And(parts):
            return reduce(and_, [compile_filter(p, scope, bare) for p in parts]) if parts else F.lit(True)
        case Or(parts):
            return reduce(or_, [compile_filter(p, scope, False) for p in parts]) if parts else F.lit(False)
        case Field(path, tests):
            column, kind = scope.resolve(path)
            return compile_tests(tests, column, kind, bare)
    raise TypeError(node)


def compile_tests(tests: tuple, column: Column, kind: T.DataType, bare: bool = False) -> Column:
    """All tests on one value; the bounds on an array hold for one of its elements together."""
    if isinstance(kind, T.VariantType):
        return compile_variant_tests(tests, column, lambda body, e: element_test(body, e, kind))
    bounds = [t for t in tests if isinstance(t, Compare) and t.op != "ne"]
    if isinstance(kind, T.ArrayType):
        out = [_any_element(column, kind, bounds)] if bounds else []
    else:
        out = [_compare(t, column, kind) for t in bounds]
    out += [_test(t, column, kind) for t in tests if t not in bounds]
    if not out:
        return F.lit(True)
    if not bare:
        out = [F.coalesce(p, F.lit(False)) for p in out]
    return reduce(and_, out)


def _any_element(column: Column, kind: T.ArrayType, bounds: list[Compare]) -> Column:
    inner = kind.elementType
    body = lambda e: reduce(and_, [F.coalesce(_compare(t, e, inner), F.lit(False)) for t in bounds])
    found = F.exists(column, body)
    if all(t.op == "eq" and t.value is None for t in bounds):
        return column.isNull() | found
    return found


def _compare(test: Compare, column: Column, kind: T.DataType) -> Column:
    """eq or a bound on one value. Other types compare by their rank; NaN is the least number."""
    op, value = test.op, test.value
    have, want = rank_of_type(kind), rank_of(value)
    if op == "eq":
        if value is None:
            return column.isNull()
        same = same_value(column, kind, value)
        return F.lit(False) if same is None else same
    if have != want:
        above = have > want
        fits = above if op in ("gt", "ge") else not above
        return column.isNotNull() if fits and have != 1 else F.lit(False)
    if want in (1, 4, 5):
        if want == 1:
            return F.lit(False)
        from brindle.functions.literals import literal

        other = literal(value, kind)
    else:
        other = F.lit(value)
    plain = {"gt": column > other, "ge": column >= other, "lt": column < other, "le": column <= other}[op]
    if not isinstance(kind, FLOATS):
        return plain
    if isinstance(value, float) and value != value:
        return {"gt": column.isNotNull() & ~F.isnan(column), "ge": column.isNotNull(), "lt": F.lit(False), "le": F.isnan(column)}[op]
    return plain & ~F.isnan(column) if op in ("gt", "ge") else plain | F.isnan(column)


def _not_equal(value, column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if value is None:
            return F.coalesce(F.exists(column, lambda e: e.isNotNull()), F.lit(False))

        def differs(e: Column) -> Column:
            same = same_value(e, inner, value)
            return F.lit(True) if same is None else F.coalesce(~same, F.lit(True))

        return column.isNull() | F.exists(column, differs)
    if value is None:
        return column.isNotNull()
    same = same_value(column, kind, value)
    return F.lit(True) if same is None else F.coalesce(~same, F.lit(True))


def member_of(column: Column, kind: T.DataType, values: tuple) -> Column:
    """The whole value is in the list; values of other types never are."""
    fitting = [v for v in values if v is not None and rank_of(v) == rank_of_type(kind)]
    if not fitting:
        return F.when(column.isNotNull(), F.lit(False))
    if isinstance(kind, T.StructType | T.ArrayType):
        tests = [same_value(column, kind, v) for v in fitting]
        tests = [t for t in tests if t is not None]
        return F.when(column.isNotNull(), reduce(or_, tests) if tests else F.lit(False))
    return column.isin(*fitting)


def _type_names(kind: T.DataType) -> set[str]:
    if isinstance(kind, NUMBERS):
        own = "decimal" if isinstance(kind, T.DecimalType) else "double" if isinstance(kind, FLOATS) else "long" if isinstance(kind, T.LongType) else "int"
        return {own, "number"}
    return {3: {"string"}, 4: {"object"}, 5: {"array"}, 6: {"binData"}, 8: {"bool"}, 9: {"date"}}.get(rank_of_type(kind), {"null"})


def _test(test, column: Column, kind: T.DataType) -> Column:
    is_array = isinstance(kind, T.ArrayType)
    match test:
        case Compare("ne", value):
            return _not_equal(value, column, kind)
        case Member(values, negated):
            inside = member_of(column, kind, values)
            return column.isNotNull() & ~F.coalesce(inside, F.lit(False)) if negated else inside
        case Exists(wanted):
            return column.isNotNull() if wanted else column.isNull()
        case HasType(name, negated):
            fits = column.isNotNull() if name in _type_names(kind) else F.lit(False)
        case HasSize(size, negated):
            fits = F.coalesce(F.size(column) == size, F.lit(False)) if is_array else F.lit(False)
        case HasAll(values, negated):
            fits = F.lit(False)
            if is_array:
                fits = column.isNotNull()
                for v in values:
                    fits = fits & _any_element(column, kind, [Compare("eq", v)])
        case ElemMatch(body, negated):
            fits = _elem_match(body, column, kind) if is_array else F.lit(False)
        case _:
            raise TypeError(test)
    return ~F.coalesce(fits, F.lit(False)) if negated else fits


def _elem_match(body, column: Column, kind: T.ArrayType) -> Column:
    if body == ():
        return F.size(column) > 0
    return F.exists(column, lambda e: element_test(body, e, kind.elementType))


def element_test(body, element: Column, kind: T.DataType) -> Column:
    """``body`` (tests or a filter on fields) as a two-valued column on one array element."""
    if isinstance(body, tuple):
        return compile_tests(body, element, kind, bare=False)
    return compile_filter(body, Scope.of_value(element, kind), bare=False)


def where(df: DataFrame, filter: dict, key: str = "_id") -> DataFrame:
    """The rows of ``df`` that a filter document selects."""
    tree = parse_filter(filter)
    return df if tree == And(()) else df.where(compile_filter(tree, Scope.of_frame(df, key)))
