"""Versioned collections of Parquet files.

A version is a manifest: schema, number of rows, and the list of files with
their zones. Writers add files first and then publish the next manifest, whole
or not at all; who loses that race sees ``VersionConflict``. Readers of an older
version keep their files. A change rewrites only the files that hold rows it
selects, and an insert none.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.errors import VersionConflict
from brindle.sources.zones import may_match, measure


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share.

    Without ``spark.checkpoint.dir`` it is in the warehouse; a local temporary
    folder serves only a session whose executors are threads of the driver.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        folder = "file://" + os.path.join(tempfile.gettempdir(), "brindle-scratch")
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/brindle-scratch"
    return folder.rstrip("/")


class Store:
    """Small files in a folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def create(self, name: str, value: dict) -> bool:
        """Publish a whole file under a name that must be free; False if it is taken.

        The bytes are written aside first, so no reader sees a part of them. The
        name is then given by a rename that does not overwrite (atomic on HDFS),
        or by a hard link on a local disk.
        """
        path, aside = self._path(name), self._path(f".{uuid.uuid4().hex}.tmp")
        fs = self._fs(path)
        if fs.exists(path):
            return False
        fs.mkdirs(path.getParent())
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        try:
            if fs.getUri().getScheme() == "file":
                plain = self._jvm.org.apache.hadoop.fs.Path.getPathWithoutSchemeAndAuthority
                os.link(plain(aside).toString(), plain(path).toString())
            else:
                hadoop = self._jvm.org.apache.hadoop.fs
                context = hadoop.FileContext.getFileContext(path.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
                none = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
                context.rename(aside, path, none)
        except Exception:
            if fs.exists(path):
                return False
            raise
        finally:
            fs.delete(aside, False)
        return True

    def read(self, name: str) -> dict:
        path = self._path(name)
        stream = self._fs(path).open(path)
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def names(self, folder: str = "") -> list[str]:
        path = self._path(folder) if folder else self._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def delete(self, name: str) -> None:
        path = self._path(name)
        self._fs(path).delete(path, True)

    def age(self, name: str) -> float:
        """Seconds since a file or folder was last changed."""
        path = self._path(name)
        return time.time() - self._fs(path).getFileStatus(path).getModificationTime() / 1000

    def latest(self, prefix: str, folder: str = "") -> int:
        found = [int(n[len(prefix) : -5]) for n in self.names(folder) if n.startswith(prefix) and n.endswith(".json")]
        return max(found, default=-1)


@dataclass
class Version:
    number: int
    schema: T.StructType | None
    rows: int = 0
    files: list[str] = field(default_factory=list)
    zones: dict[str, dict] = field(default_factory=dict)


class VersionedTable:
    """``paths`` are the fields whose zones are kept; ``written`` are options of the Parquet writer."""

    def __init__(self, spark: SparkSession, root: str, written: dict[str, str] | None = None, paths: list[str] | None = None):
        self.spark, self.store, self.written, self.paths = spark, Store(spark, root), written or {}, paths or []
        self._fresh: dict[str, dict] = {}

    def version(self, number: int | None = None) -> Version:
        number = self.store.latest("manifest-") if number is None else number
        if number < 0:
            return Version(-1, None)
        m = self.store.read(f"manifest-{number}.json")
        return Version(number, T.StructType.fromJson(m["schema"]) if m["schema"] else None, m["rows"], m["files"], m.get("zones", {}))

    def files_for(self, version: Version, tree) -> list[str]:
        """The files in which a row may pass the filter ``tree``."""
        return version.files if tree is None else [f for f in version.files if may_match(tree, version.zones.get(f, {}))]

    def frame(self, version: Version | None = None, files: list[str] | None = None, tree=None) -> DataFrame:
        version = version or self.version()
        schema = version.schema or T.StructType([])
        files = self.files_for(version, tree) if files is None else files
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.store.root}/{f}" for f in files])

    def write(self, df: DataFrame) -> list[str]:
        folder = f"data/{uuid.uuid4().hex}"
        df.write.options(**self.written).parquet(f"{self.store.root}/{folder}")
        files = [f"{folder}/{n}" for n in self.store.names(folder) if n.endswith(".parquet")]
        self._fresh |= self.measure(files, T.StructType.fromJson(df.schema.jsonValue()))
        return files

    def measure(self, files: list[str], schema: T.StructType) -> dict[str, dict]:
        if not files or not self.paths:
            return {}
        return {_relative(f): z for f, z in measure(self.frame(Version(0, schema, 0, files)), self.paths).items()}

    def discard(self, files: list[str]) -> None:
        """Delete files that were written and will not be committed."""
        for folder in {f.rsplit("/", 1)[0] for f in files}:
            self.store.delete(folder)

    def commit(self, seen: Version, schema: T.StructType, rows: int, files: list[str]) -> Version:
        number = seen.number + 1
        zones = {f: z for f in files if (z := self._fresh.get(f, seen.zones.get(f)))}
        made = {"schema": schema.jsonValue(), "rows": rows, "files": files, "zones": zones}
        if not self.store.create(f"manifest-{number}.json", made):
            self.discard([f for f in files if f not in set(seen.files)])
            raise VersionConflict(f"Version {number} was committed by another writer")
        return Version(number, schema, rows, files, zones)

    def hits(self, seen: Version, predicate, tree=None) -> dict[str, int]:
        """Selected rows of each file that has any: one scan of the files that may have one."""
        df = self.frame(seen, tree=tree)
        rows = df.where(predicate).groupBy(F.input_file_name().alias("f")).count().collect()
        return {_relative(r["f"]): r["count"] for r in rows}

    def rewrite(self, seen: Version, hits: dict[str, int], change, deletes: bool = False) -> Version:
        """Replace the files with selected rows by ``change`` of their rows; other files stay."""
        touched = [f for f in seen.files if f in hits]
        if not touched:
            return seen
        new = change(self.frame(seen, touched))
        files = [f for f in seen.files if f not in hits] + self.write(new)
        return self.commit(seen, T.StructType.fromJson(new.schema.jsonValue()), seen.rows - deletes * sum(hits.values()), files)

    def compact(self, keys: list[str], parts: int) -> Version:
        """One sorted set of files instead of many, so that zones and Parquet's statistics prune scans by ``keys``."""
        seen = self.version()
        if not seen.files:
            return seen
        columns = [F.col(".".join("`" + p + "`" for p in k.split("."))) for k in keys]
        df = self.frame(seen).repartitionByRange(parts, *columns).sortWithinPartitions(*columns)
        return self.commit(seen, seen.schema, seen.rows, self.write(df))

    def vacuum(self, older_than: float) -> int:
        """Delete files and manifests that the newest version does not need and that nobody has touched for ``older_than`` seconds.

        A writer that has not committed yet has written its files within that
        time; a reader of an older version has begun within it.
        """
        now = self.version()
        used = {f.split("/")[1] for f in now.files}
        gone = [n for n in self.store.names("data") if n not in used and self.store.age(f"data/{n}") >= older_than]
        for n in gone:
            self.store.delete(f"data/{n}")
        for n in self.store.names():
            if n.startswith("manifest-") and n != f"manifest-{now.number}.json" and self.store.age(n) >= older_than:
                self.store.delete(n)
        return len(gone)


def _relative(uri: str) -> str:
    """A file's name below the table's folder."""
    return "/".join(uri.split("/")[-3:])
