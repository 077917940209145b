"""Databases of named collections: catalog, reads and writes."""

from __future__ import annotations

import itertools
import secrets
import threading
import time
from dataclasses import dataclass
from enum import Enum
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.errors import (
    CollectionAlreadyExists,
    CollectionNotFound,
    DuplicateKey,
    IndexNotFound,
    IndexOptionsConflict,
    InvalidRequest,
    VersionConflict,
)
from brindle.functions.literals import common_type, type_of
from brindle.functions.predicates import Scope, compile_filter
from brindle.operators.find import Find, to_document
from brindle.operators.project import project, sort_columns
from brindle.operators.update import apply_update, fit
from brindle.plans.filters import Compare, Field, equalities, parse_filter, parse_path
from brindle.plans.projections import parse_projection, parse_sort
from brindle.plans.updates import check_replacement, parse_update
from brindle.metrics import Metrics
from brindle.sources.storage import Store, Version, VersionedTable

KEY = "_id"
RETRY_SECONDS, FIRST_WAIT, LAST_WAIT = 5.0, 0.005, 1.0


class IdStrategy(Enum):
    GENERATED = "generated"
    MANUAL = "manual"
    MIXED = "mixed"


class ReturnDocument(Enum):
    BEFORE = "before"
    AFTER = "after"


@dataclass(frozen=True)
class Options:
    """Settings of a database: how Parquet files are written, and files after compaction.

    ``bloom`` is the rate of false positives of a Bloom filter on the key in each
    file (0: none); ``page_bytes`` and ``group_bytes`` are sizes of Parquet's
    pages and row groups; ``keep_seconds`` is how long ``vacuum`` leaves what the
    newest version does not need.
    """

    compression: str = "zstd"
    compact_files: int = 8
    bloom: float = 0.01
    page_bytes: int = 1 << 20
    group_bytes: int = 128 << 20
    keep_seconds: float = 86_400.0

    def __post_init__(self) -> None:
        if self.compression not in ("none", "lz4_raw", "zstd", "snappy"):
            raise InvalidRequest(f"Unknown compression: {self.compression}")
        if min(self.compact_files, self.page_bytes, self.group_bytes) < 1:
            raise InvalidRequest("Numbers of files and sizes must be positive")
        if not 0 <= self.bloom < 1 or self.keep_seconds < 0:
            raise InvalidRequest("bloom is a rate below 1, keep_seconds not negative")

    @classmethod
    def optimized(cls) -> Options:
        return cls("zstd", 64, 0.005)

    @classmethod
    def high_query_load(cls) -> Options:
        return cls("lz4_raw", 256, 0.001, 256 << 10)

    def writer(self) -> dict[str, str]:
        out = {"compression": self.compression, "parquet.page.size": str(self.page_bytes), "parquet.block.size": str(self.group_bytes)}
        if self.bloom:
            out |= {f"parquet.bloom.filter.enabled#{KEY}": "true", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.fpp": str(self.bloom)}
        return out


@dataclass(frozen=True)
class UpdateResult:
    matched_count: int
    modified_count: int
    upserted_id: Any = None


@dataclass(frozen=True)
class DeleteResult:
    deleted_count: int


@dataclass(frozen=True)
class InsertOneResult:
    inserted_id: Any


@dataclass(frozen=True)
class InsertManyResult:
    inserted_ids: list


@dataclass(frozen=True)
class CollectionInfo:
    id: int
    name: str
    created_at: float
    id_strategy: IdStrategy


@dataclass(frozen=True)
class IndexInfo:
    id: int
    name: str
    fields: list[tuple[str, int]]


class Picked(NamedTuple):
    """A document as it was before a change."""

    row: Row
    schema: T.StructType

    @property
    def key(self) -> Any:
        return self.row[KEY]


_lock, _counter = threading.Lock(), itertools.count(secrets.randbits(22))


def new_id() -> int:
    """A 64-bit integer that grows with time: milliseconds, then a counter that starts at random in each process.

    Two processes give the same only by chance within one millisecond; an insert
    finds that and takes new ones.
    """
    with _lock:
        return (int(time.time() * 1000) << 22) | (next(_counter) & 0x3FFFFF)


class Database:
    """Collections below one folder. The catalog is a chain of files, each created exclusively."""

    def __init__(self, spark: SparkSession, root: str, options: Options | None = None):
        self.spark, self.root, self.options = spark, root.rstrip("/"), options or Options()
        self.store = Store(spark, f"{self.root}/catalog")
        self.metrics = Metrics()

    def _catalog(self) -> tuple[int, dict]:
        at = self.store.latest("catalog-")
        return (at, self.store.read(f"catalog-{at}.json")) if at >= 0 else (at, {"next": 1, "collections": {}})

    def _change(self, edit) -> Any:
        """Apply ``edit`` to the newest catalog, again if another writer was faster."""
        while True:
            at, catalog = self._catalog()
            out = edit(catalog)
            if self.store.create(f"catalog-{at + 1}.json", catalog):
                return out

    def create_collection(self, name: str, id_strategy: IdStrategy = IdStrategy.MIXED) -> Collection:
        if not name:
            raise InvalidRequest("A collection needs a name")

        def edit(catalog: dict) -> None:
            if name in catalog["collections"]:
                raise CollectionAlreadyExists(name)
            catalog["collections"][name] = {"id": catalog["next"], "created_at": time.time(), "ids": id_strategy.value, "indexes": []}
            catalog["next"] += 1

        self._change(edit)
        return self.collection(name)

    def drop_collection(self, name: str) -> None:
        _, catalog = self._catalog()
        if name not in catalog["collections"]:
            return
        own = self._change(lambda c: c["collections"].pop(name, None))
        if own:
            Store(self.spark, self.root).delete(f"collection-{own['id']}")

    def rename_collection(self, name: str, new: str) -> None:
        def edit(catalog: dict) -> None:
            if name not in catalog["collections"]:
                raise CollectionNotFound(name)
            if new in catalog["collections"]:
                raise CollectionAlreadyExists(new)
            catalog["collections"][new] = catalog["collections"].pop(name)

        self._change(edit)

    def list_collections(self) -> list[CollectionInfo]:
        own = self._catalog()[1]["collections"]
        return [CollectionInfo(c["id"], n, c["created_at"], IdStrategy(c["ids"])) for n, c in sorted(own.items())]

    def collection(self, name: str) -> Collection:
        return Collection(self, name)


class Collection:
    def __init__(self, db: Database, name: str, lenient: bool = False):
        self.db, self.name, self.lenient = db, name, lenient

    def create_if_missing(self) -> Collection:
        return Collection(self.db, self.name, True)

    # Catalog

    def _entry(self, create: bool = False) -> dict | None:
        own = self.db._catalog()[1]["collections"].get(self.name)
        if own is None and create and self.lenient:
            try:
                self.db.create_collection(self.name)
            except CollectionAlreadyExists:
                pass
            own = self.db._catalog()[1]["collections"].get(self.name)
        if own is None and not self.lenient:
            raise CollectionNotFound(self.name)
        return own

    def _table(self, create: bool = False) -> VersionedTable | None:
        own = self._entry(create)
        if own is None:
            return None
        paths = [KEY, *(path for index in own["indexes"] for path, _ in index["fields"])]
        return VersionedTable(self.db.spark, f"{self.db.root}/collection-{own['id']}", self.db.options.writer(), paths)

    def drop(self) -> None:
        self.db.drop_collection(self.name)

    def rename(self, new: str) -> Collection:
        self.db.rename_collection(self.name, new)
        return self.db.collection(new)

    def create_index(self, keys: dict, name: str | None = None) -> str:
        fields = parse_sort(keys)
        if not fields:
            raise InvalidRequest("An index needs keys")
        paths = [p for p, _ in fields]
        if any(s.isdigit() for p in paths for s in p):
            raise InvalidRequest("An index key cannot be an array element")
        for i, a in enumerate(paths):
            for b in paths[i + 1 :]:
                n = min(len(a), len(b))
                if a[:n] == b[:n]:
                    raise InvalidRequest("Index keys overlap")
        own = [[".".join(p), way] for p, way in fields]
        name = name or "_".join(f"{p}_{way}" for p, way in own)
        self._entry(create=True)

        def edit(catalog: dict) -> None:
            for index in catalog["collections"][self.name]["indexes"]:
                if index["name"] == name and index["fields"] == own:
                    return
                if index["name"] == name or index["fields"] == own:
                    raise IndexOptionsConflict(name)
            catalog["collections"][self.name]["indexes"].append({"id": catalog["next"], "name": name, "fields": own})
            catalog["next"] += 1

        self.db._change(edit)
        self._retry(self._measure)
        return name

    def _measure(self) -> None:
        """Zones of the files that were written before an index was created."""
        table = self._table()
        seen = table.version()
        if seen.files and any(p not in z for p in table.paths for z in (seen.zones.get(f, {}) for f in seen.files)):
            table._fresh |= table.measure(seen.files, seen.schema)
            table.commit(seen, seen.schema, seen.rows, seen.files)

    def list_indexes(self) -> list[IndexInfo]:
        own = self._entry()
        return [IndexInfo(i["id"], i["name"], [tuple(f) for f in i["fields"]]) for i in own["indexes"]] if own else []

    def drop_index(self, name: str) -> None:
        self._entry()

        def edit(catalog: dict) -> None:
            indexes = catalog["collections"].get(self.name, {"indexes": []})["indexes"]
            if not any(i["name"] == name for i in indexes):
                raise IndexNotFound(name)
            indexes[:] = [i for i in indexes if i["name"] != name]

        self.db._change(edit)

    # Reads

    def frame(self, version: int | None = None, filter: dict | None = None) -> DataFrame:
        """The collection as a DataFrame, at the newest version or at an older one.

        With ``filter``, files whose zones rule its rows out are left out; the
        rows are not filtered yet.
        """
        table = self._table()
        seen = table.version(version) if table else Version(-1, None)
        if seen.schema is None:
            return self.db.spark.createDataFrame([], T.StructType([T.StructField(KEY, T.LongType())]))
        tree = parse_filter(filter) if filter else None
        files = table.files_for(seen, tree)
        self.db.metrics.scanned(tree, len(files), len(seen.files))
        return table.frame(seen, files)

    def version(self) -> int:
        return self._table().version().number

    def find(self, filter: dict | None = None) -> Find:
        self.db.metrics["reads"] += 1
        return Find(self.frame(filter=filter), filter, KEY, self.db.metrics)

    def find_one(self, filter: dict | None = None, projection: dict | None = None, sort: dict | None = None) -> dict | None:
        query = self.find(filter)
        if projection:
            query.projection(projection)
        if sort:
            query.sort(sort)
        return query.execute_one()

    def estimated_document_count(self) -> int:
        table = self._table()
        return table.version().rows if table else 0

    # Inserts

    def _with_ids(self, docs: list[dict], strategy: IdStrategy) -> list[dict]:
        out = []
        for doc in docs:
            if not isinstance(doc, dict):
                raise InvalidRequest("A document is needed")
            if KEY in doc:
                if strategy == IdStrategy.GENERATED:
                    raise InvalidRequest("This collection generates its ids")
                out.append(doc)
            else:
                if strategy == IdStrategy.MANUAL:
                    raise InvalidRequest("This collection needs an _id")
                out.append({KEY: new_id(), **doc})
        return out

    def insert_one(self, doc: dict) -> InsertOneResult:
        return InsertOneResult(self.insert_many([doc]).inserted_ids[0])

    def insert_many(self, docs: list[dict]) -> InsertManyResult:
        docs = list(docs)
        if not docs:
            return InsertManyResult([])
        strategy = IdStrategy(self._entry(create=True)["ids"])
        own = self._with_ids(docs, strategy)
        try:
            return self._insert(own)
        except DuplicateKey:
            if all(KEY in d for d in docs):
                raise
            return self._insert(self._with_ids(docs, strategy))  # a new id that another process has given, too

    def _insert(self, docs: list[dict]) -> InsertManyResult:
        ids = [d[KEY] for d in docs]
        if len({repr(i) for i in ids}) < len(ids):
            raise DuplicateKey("An id is given twice")
        kind = type_of(docs[0])
        for d in docs[1:]:
            kind = common_type(kind, type_of(d))
        new = self.db.spark.createDataFrame([_as_row(d, kind) for d in docs], nullable(kind), verifySchema=False)
        self.insert_frame(new)
        return InsertManyResult(ids)

    def insert_frame(self, new: DataFrame) -> int:
        """Insert a DataFrame with an ``_id`` column: the way in for large data. All or nothing.

        The input is evaluated once: what was written is checked, against itself
        and against the files in whose zones its keys lie, and then committed.
        """
        table = self._table(create=True)
        seen = table.version()
        schema = nullable(new.schema)
        if seen.schema is not None:
            schema = nullable(common_type(seen.schema, schema))
        shaped = new.select(*[
            (fit(F.col(f"`{f.name}`"), new.schema[f.name].dataType, f.dataType) if f.name in new.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema
        ])
        files = table.write(shaped)
        try:
            rows = self._check_new(table, seen, table.frame(Version(-1, schema, 0, files)))
        except Exception:
            table.discard(files)
            raise
        table.commit(seen, schema, seen.rows + rows, seen.files + files)
        self.db.metrics["documents_written"] += rows
        return rows

    def _check_new(self, table: VersionedTable, seen: Version, written: DataFrame) -> int:
        own = written.agg(F.count(F.lit(1)).alias("n"), F.count(KEY).alias("keys"), F.min(KEY).alias("lo"), F.max(KEY).alias("hi")).first()
        if own["keys"] < own["n"]:
            raise InvalidRequest("A document needs an _id that is not null")
        if own["n"] > 1 and written.groupBy(KEY).count().where("count > 1").limit(1).collect():
            raise DuplicateKey("An id is given twice")
        if own["n"] and seen.rows:
            ordered = isinstance(own["lo"], int | float | str) and own["lo"] == own["lo"] and own["hi"] == own["hi"]
            tree = Field((KEY,), (Compare("ge", own["lo"]), Compare("le", own["hi"]))) if ordered else None
            near = table.frame(seen, tree=tree)
            if near.select(KEY).join(written.select(KEY), KEY, "left_semi").limit(1).collect():
                raise DuplicateKey("An id is in the collection already")
        return own["n"]

    # Updates and deletes

    def _retry(self, work):
        """Single-document writes try again when another writer was faster."""
        wait, end = FIRST_WAIT, time.monotonic() + RETRY_SECONDS
        while True:
            try:
                return work()
            except VersionConflict:
                if time.monotonic() > end:
                    raise
                time.sleep(wait)
                wait = min(2 * wait, LAST_WAIT)

    def _pick(self, df: DataFrame, filter: dict, sort: dict | None):
        """The first matching row by ``sort``, else by key."""
        scope = Scope.of_frame(df, KEY)
        keys = sort_columns(scope, parse_sort(sort)) if sort else [F.col(KEY)]
        row = df.where(compile_filter(parse_filter(filter), scope)).orderBy(*keys).limit(1).first()
        return None if row is None else Picked(row, df.schema)

    def _write(self, filter: dict, update, one: bool, sort=None, upsert=False) -> tuple[UpdateResult, Any, Any]:
        """Result, and for one document its pre-image and key."""
        table = self._table(create=upsert)
        seen = table.version() if table else Version(-1, None)
        tree = parse_filter(filter)
        df = table.frame(seen, tree=tree) if seen.schema is not None else None
        before, hits = None, {}
        if df is not None:
            if one:
                before = self._pick(df, filter, sort)
            if before or not one:
                hit, near = self._hit(before, tree, df)
                hits = table.hits(seen, hit, near)
        matched = sum(hits.values())
        if not matched:
            if not upsert:
                return UpdateResult(0, 0), None, None
            doc_id = self._upsert(tree, update)
            return UpdateResult(0, 0, doc_id), None, doc_id
        table.rewrite(seen, hits, lambda part: apply_update(part, update, hit, KEY))
        self.db.metrics["documents_written"] += matched
        return UpdateResult(matched, matched), before, before.key if one else None

    def _hit(self, before: Picked | None, tree, df: DataFrame):
        """The predicate of the rows to change, and a filter that their files' zones are held against."""
        if before is not None:
            return F.col(KEY) == F.lit(before.key), Field((KEY,), (Compare("eq", before.key),))
        return compile_filter(tree, Scope.of_frame(df, KEY), bare=False), tree

    def _upsert(self, tree, update) -> Any:
        base: dict = {}
        for path, value in equalities(tree).items():
            at = base
            for step in path[:-1]:
                at = at.setdefault(step, {})
            at[path[-1]] = value
        doc_id = base.pop(KEY, None)
        generated = doc_id is None
        doc_id = new_id() if generated else doc_id
        doc = {KEY: doc_id, **base}
        kind = nullable(type_of(doc))
        row = self.db.spark.createDataFrame([_as_row(doc, kind)], kind, verifySchema=False)
        self.insert_frame(apply_update(row, update, F.lit(True), KEY, inserting=True))
        return doc_id

    def update_one(self, filter: dict, update: dict, array_filters=None, upsert=False, sort: dict | None = None) -> UpdateResult:
        parsed = parse_update(update, array_filters)
        return self._retry(lambda: self._write(filter, parsed, True, sort, upsert)[0])

    def update_many(self, filter: dict, update: dict, array_filters=None, upsert=False) -> UpdateResult:
        return self._write(filter, parse_update(update, array_filters), False, None, upsert)[0]

    def find_one_and_update(self, filter: dict, update: dict, projection=None, sort=None, upsert=False, return_document=ReturnDocument.BEFORE):
        parsed = parse_update(update)
        result, before, key = self._retry(lambda: self._write(filter, parsed, True, sort, upsert))
        return self._image(before, key, projection, return_document)

    def _image(self, before, key, projection, which: ReturnDocument) -> dict | None:
        if key is None:
            return None
        if which == ReturnDocument.AFTER:
            return self.find_one({KEY: key}, projection)
        return _projected(self.db.spark, before, projection) if before is not None else None

    def _replace(self, filter: dict, doc: dict, sort, upsert) -> tuple[UpdateResult, Any, Any]:
        check_replacement(doc)
        table = self._table(create=upsert)
        seen = table.version() if table else Version(-1, None)
        before = self._pick(table.frame(seen, tree=parse_filter(filter)), filter, sort) if seen.schema is not None else None
        if before is None:
            if not upsert:
                return UpdateResult(0, 0), None, None
            wanted = equalities(parse_filter(filter)).get((KEY,))
            if wanted is not None and doc.get(KEY, wanted) != wanted:
                raise InvalidRequest("The replacement's _id differs from the filter's")
            doc_id = doc.get(KEY, wanted)
            new = {KEY: new_id() if doc_id is None else doc_id, **{k: v for k, v in doc.items() if k != KEY}}
            kind = nullable(type_of(new))
            self.insert_frame(self.db.spark.createDataFrame([_as_row(new, kind)], kind, verifySchema=False))
            return UpdateResult(0, 0, new[KEY]), None, new[KEY]
        if doc.get(KEY, before.key) != before.key:
            raise InvalidRequest("_id cannot be changed")
        new = {**doc, KEY: before.key}
        schema = nullable(common_type(seen.schema, type_of(new)))
        row = self.db.spark.createDataFrame([_as_row(new, schema)], schema, verifySchema=False)
        hit, near = self._hit(before, None, None)

        def change(part: DataFrame) -> DataFrame:
            return part.where(~hit).unionByName(row, allowMissingColumns=True)

        table.rewrite(seen, table.hits(seen, hit, near), change)
        self.db.metrics["documents_written"] += 1
        return UpdateResult(1, 1), before, before.key

    def replace_one(self, filter: dict, doc: dict, upsert=False, sort=None) -> UpdateResult:
        return self._retry(lambda: self._replace(filter, doc, sort, upsert)[0])

    def find_one_and_replace(self, filter: dict, doc: dict, projection=None, sort=None, upsert=False, return_document=ReturnDocument.BEFORE):
        _, before, key = self._retry(lambda: self._replace(filter, doc, sort, upsert))
        return self._image(before, key, projection, return_document)

    def _delete(self, filter: dict, one: bool, sort=None) -> tuple[int, Any]:
        table = self._table()
        seen = table.version() if table else Version(-1, None)
        if seen.schema is None:
            return 0, None
        tree = parse_filter(filter)
        df = table.frame(seen, tree=tree)
        before = self._pick(df, filter, sort) if one else None
        if one and before is None:
            return 0, None
        hit, near = self._hit(before, tree, df)
        hits = table.hits(seen, hit, near)
        after = table.rewrite(seen, hits, lambda part: part.where(~hit), deletes=True)
        return seen.rows - after.rows, before

    def delete_one(self, filter: dict, sort: dict | None = None) -> DeleteResult:
        return DeleteResult(self._retry(lambda: self._delete(filter, True, sort)[0]))

    def delete_many(self, filter: dict) -> DeleteResult:
        return DeleteResult(self._delete(filter, False)[0])

    def find_one_and_delete(self, filter: dict, projection=None, sort=None) -> dict | None:
        _, before = self._retry(lambda: self._delete(filter, True, sort))
        return _projected(self.db.spark, before, projection) if before is not None else None

    def compact(self, index: str | None = None) -> None:
        """Sort the collection by its key, or by an index, into few files."""
        keys = [KEY]
        if index is not None:
            found = [i for i in self.list_indexes() if i.name == index]
            if not found:
                raise IndexNotFound(index)
            keys = [path for path, _ in found[0].fields]
        self._table().compact(keys, self.db.options.compact_files)

    def vacuum(self, older_than: float | None = None) -> int:
        return self._table().vacuum(self.db.options.keep_seconds if older_than is None else older_than)


def nullable(kind: T.DataType) -> T.DataType:
    """The same type with every part nullable; a type without values becomes a string."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(nullable(kind.elementType))
    return T.StringType() if isinstance(kind, T.NullType) else kind


def _as_row(value: Any, kind: T.DataType) -> Any:
    """A document as the nested tuples that a schema expects; missing fields are null."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(_as_row(value.get(f.name), f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return [_as_row(v, kind.elementType) for v in value]
    return float(value) if isinstance(kind, T.DoubleType) else value


def _projected(spark: SparkSession, before: Picked, projection: dict | None) -> dict:
    if not projection:
        return to_document(before.row)
    df = spark.createDataFrame([tuple(before.row)], before.schema)
    return to_document(project(df, parse_projection(projection), KEY).first())


def open_database(spark: SparkSession, root: str, options: Options | None = None) -> Database:
    return Database(spark, root, options)


__all__ = ["Collection", "Database", "IdStrategy", "Options", "ReturnDocument", "open_database", "parse_path"]
