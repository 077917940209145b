"""Projections and sorts as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import dynamic
from brindle.functions.dynamic import take
from brindle.functions.literals import FLOATS
from brindle.functions.predicates import Scope, element_test
from brindle.plans.projections import Match, Projection, Slice


def project(df: DataFrame, projection: Projection, key: str = "_id") -> DataFrame:
    scope = Scope.of_frame(df, key)
    id_name = "_id" if "_id" in df.columns else key
    out: list[Column] = []
    if projection.include:
        if projection.with_id and id_name in df.columns:
            out.append(scope.column(id_name))
        for name in sorted(projection.tree):
            if name in df.columns and name != id_name:
                kept = _keep(scope.column(name), df.schema[name].dataType, projection.tree[name])
                if kept is not None:
                    out.append(kept.alias(name))
        return df.select(*out)
    for f in df.schema:
        rule = projection.tree.get(f.name)
        if rule is True or (f.name == id_name and not projection.with_id):
            continue
        column = scope.column(f.name)
        out.append(column if rule is None else _drop(column, f.dataType, rule).alias(f.name))
    return df.select(*out)


def _keep(column: Column, kind: T.DataType, rule) -> Column | None:
    if rule is True:
        return column
    if isinstance(kind, T.VariantType):
        return dynamic.keep(column, rule, lambda body, e: element_test(body, e, kind))
    if isinstance(rule, Slice):
        return take(column, rule) if isinstance(kind, T.ArrayType) else None
    if isinstance(rule, Match):
        if not isinstance(kind, T.ArrayType):
            return None
        return F.filter(column, lambda e: element_test(rule.body, e, kind.elementType))
    parts = []
    for step in sorted(rule):
        if isinstance(kind, T.StructType) and step in kind.names:
            part = _keep(column.getField(step), kind[step].dataType, rule[step])
        elif isinstance(kind, T.ArrayType) and step.isdigit():
            part = _keep(F.get(column, F.lit(int(step))), kind.elementType, rule[step])
        else:
            part = None
        if part is not None:
            parts.append(part.alias(step))
    return F.when(column.isNotNull(), F.struct(*parts)) if parts else None


def _drop(column: Column, kind: T.DataType, rule: dict) -> Column:
    if isinstance(kind, T.VariantType):
        return dynamic.drop(column, rule)
    if not isinstance(kind, T.StructType):
        return column
    parts = []
    for f in kind:
        inner = rule.get(f.name)
        if inner is True:
            continue
        own = column.getField(f.name)
        parts.append((own if inner is None else _drop(own, f.dataType, inner)).alias(f.name))
    return F.when(column.isNotNull(), F.struct(*parts)) if parts else F.lit(None).cast(T.StructType([]))


def sort_columns(scope: Scope, keys: list[tuple[tuple[str, ...], int]]) -> list[Column]:
    """Missing first when ascending; NaN below every number."""
    out = []
    for path, way in keys:
        column, kind = scope.resolve(path)
        if isinstance(kind, T.VariantType):
            out += [c.asc_nulls_first() if way > 0 else c.desc_nulls_last() for c in dynamic.sort_keys(column)]
            continue
        if isinstance(kind, FLOATS):
            nan = F.coalesce(F.isnan(column), F.lit(False))
            missing = column.isNull()
            out.append(missing.desc() if way > 0 else missing.asc())
            out.append(nan.desc() if way > 0 else nan.asc())
        out.append(column.asc_nulls_first() if way > 0 else column.desc_nulls_last())
    return out
