"""``find``: filter, sort, skip, limit and projection over a DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.types import VariantVal

from brindle.functions.predicates import Scope, where
from brindle.metrics import Metrics
from brindle.operators.project import project, sort_columns
from brindle.plans.projections import parse_projection, parse_sort


class Find:
    """A query under construction; every step returns the query itself."""

    def __init__(self, df: DataFrame, filter: dict | None = None, key: str = "_id", metrics: Metrics | None = None):
        self._df, self._filter, self._key, self._metrics = df, filter or {}, key, Metrics() if metrics is None else metrics
        self._projection = self._sort = self._skip = self._limit = None

    def projection(self, doc: dict) -> Find:
        self._projection = parse_projection(doc)
        return self

    def sort(self, doc: dict) -> Find:
        self._sort = parse_sort(doc)
        return self

    def skip(self, n: int) -> Find:
        self._skip = n
        return self

    def limit(self, n: int) -> Find:
        self._limit = n
        return self

    def frame(self, ordered: bool = True) -> DataFrame:
        """The result as a DataFrame. Rows are sorted before they are projected, so a
        sort key may be projected away. Without a sort the order is that of the key;
        ``ordered=False`` leaves it open and saves the shuffle where no limit needs it."""
        df = where(self._df, self._filter, self._key)
        scope = Scope.of_frame(df, self._key)
        cut = self._skip is not None or self._limit is not None
        if self._sort:
            df = df.orderBy(*sort_columns(scope, self._sort))
        elif (ordered or cut) and self._key in df.columns:
            df = df.orderBy(scope.column(self._key))
        if self._skip:
            df = df.offset(self._skip)
        if self._limit is not None:
            df = df.limit(self._limit)
        return project(df, self._projection, self._key) if self._projection else df

    def execute(self) -> Iterator[dict]:
        """The documents, fetched partition by partition as they are asked for."""
        self._metrics["sorts"] += bool(self._sort)
        return self._fetched(self.frame())

    def _fetched(self, df: DataFrame) -> Iterator[dict]:
        with self._metrics.timed("find"):
            for row in df.toLocalIterator(prefetchPartitions=True):
                self._metrics["rows_returned"] += 1
                yield to_document(row)

    def execute_one(self) -> dict | None:
        self._metrics["sorts"] += bool(self._sort)
        with self._metrics.timed("find_one"):
            row = self.limit(1).frame().first()
        self._metrics["rows_returned"] += row is not None
        return None if row is None else to_document(row)


def to_document(value):
    """A row as a document: missing fields (nulls outside arrays) are left out."""
    if isinstance(value, Row):
        return {k: to_document(v) for k, v in value.asDict().items() if v is not None}
    if isinstance(value, list):
        return [to_document(v) for v in value]
    return value.toPython() if isinstance(value, VariantVal) else value


def find(df: DataFrame, filter: dict | None = None, key: str = "_id") -> Find:
    return Find(df, filter, key)
