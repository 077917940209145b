"""Zones: the least and greatest value of the key and of indexed fields in each file.

They stand in the manifest beside the file's name. A scan leaves out the files
whose zones no row that passes the filter can lie in.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.literals import FLOATS, INTEGERS, rank_of
from brindle.plans.filters import And, Compare, Field, Member, Or

#: Longer texts get no zone, so that manifests stay small.
LONGEST_TEXT = 128


def _column(schema: T.StructType, path: str) -> tuple[Column, T.DataType] | None:
    """The column at a path that leads through documents only, if its type has zones."""
    kind: T.DataType = schema
    column = None
    for name in path.split("."):
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return None
        kind = kind[name].dataType
        column = F.col("`" + name.replace("`", "``") + "`") if column is None else column.getField(name)
    return (column, kind) if isinstance(kind, (*INTEGERS, *FLOATS, T.StringType)) else None


def measure(df: DataFrame, paths: list[str]) -> dict[str, dict[str, list]]:
    """file name → path → [least, greatest]; [] where the file has no value there, nothing where no bound is known.

    One pass over the columns of ``paths``, with one row a file.
    """
    known = {p: found for p in dict.fromkeys(paths) if (found := _column(df.schema, p))}
    if not known:
        return {}
    sums: list[Column] = []
    for i, (column, kind) in enumerate(known.values()):
        odd = F.isnan(column) if isinstance(kind, FLOATS) else F.length(column) > LONGEST_TEXT if isinstance(kind, T.StringType) else F.lit(False)
        sums += [F.min(column).alias(f"lo{i}"), F.max(column).alias(f"hi{i}"), F.max(F.coalesce(odd, F.lit(False))).alias(f"odd{i}")]
    out = {}
    for row in df.groupBy(F.input_file_name().alias("file")).agg(*sums).collect():
        zones = {}
        for i, path in enumerate(known):
            if not row[f"odd{i}"]:
                zones[path] = [] if row[f"lo{i}"] is None else [row[f"lo{i}"], row[f"hi{i}"]]
        out[row["file"]] = zones
    return out


def may_match(node: Any, zones: dict[str, list]) -> bool:
    """False only if no row of a file with these zones can pass the filter."""
    match node:
        case And(parts):
            return all(may_match(p, zones) for p in parts)
        case Or(parts):
            return any(may_match(p, zones) for p in parts)
        case Field(path, tests):
            zone = zones.get(".".join(path))
            return zone is None or all(_may(t, zone) for t in tests)
    return True


def _may(test: Any, zone: list) -> bool:
    if isinstance(test, Member) and not test.negated:
        return any(_may(Compare("eq", v), zone) for v in test.values)
    if not isinstance(test, Compare) or test.op == "ne" or test.value is None or test.value != test.value:
        return True
    if not zone:
        return rank_of(test.value) not in (2, 3)
    low, high = zone
    if rank_of(test.value) != rank_of(low):
        return True
    value = test.value
    return {"eq": low <= value <= high, "gt": high > value, "ge": high >= value, "lt": low < value, "le": low <= value}[test.op]
