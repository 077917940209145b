"""The filter, projection and update languages over streaming frames.

They compile to columns, so a stream takes them as a batch does; sorts, skips
and limits need a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from brindle.functions.predicates import where
from brindle.operators.project import project
from brindle.operators.update import apply_update
from brindle.plans.projections import parse_projection
from brindle.plans.updates import parse_update


def transform_stream(stream: DataFrame, filter: dict | None = None, projection: dict | None = None, update: dict | None = None, key: str = "_id") -> DataFrame:
    """Select rows, change them and project them, in that order."""
    out = where(stream, filter or {}, key)
    if update:
        out = apply_update(out, parse_update(update), None, key)
    return project(out, parse_projection(projection), key) if projection else out
