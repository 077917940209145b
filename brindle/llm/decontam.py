"""Benchmark decontamination by a prefix-filtered join with exact verification.

A window is ``size`` consecutive words of a benchmark item, its tokens are its
shingles of five words (all its words, if it has fewer). A document that holds
the window holds each of them, so one is a necessary prefix: the rarest, by how
often each shingle stands in the corpus. Documents and windows are joined on it.
The shingle's offset and the window's length bound the place, and the words
there are compared.

Texts are read once: a bit table of the benchmark's shingles, of bounded size,
picks the places that can matter, exactly or with some chance places more. The
counts, the choice of prefixes and the join take these places; a text is moved
only if it has one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import ddl_name, drop_scratch, free_name, scratch, sliced, text_bytes, views

#: Words of a shingle, probes of the bit table, and bits that it has for each shingle while it is below its bound.
SHINGLE, PROBES, BITS = 5, 4, 64
#: Bytes that are split, and shingles that are hashed, at a time.
PIECE, CHUNK = 1 << 20, 1 << 18
#: Bytes that belong to words: digits, small letters, all of UTF-8 beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_KEEP = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words after lower-casing A-Z; bytes and words keep their places."""
    return text.translate(_KEEP).split()


def windows_of(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def runs(flags: bytearray) -> list[tuple[int, int]]:
    return [(m.start(), m.end()) for m in re.finditer(rb"\x01+", flags)]


def word_hashes(text: bytes) -> np.ndarray:
    """The CRC-32 of each word of a text; long texts are split piece by piece, at spaces."""
    low, at, out = text.translate(_KEEP), 0, [np.zeros(0, dtype=np.uint64)]
    while at < len(low):
        end = low.find(b" ", at + PIECE)
        end = len(low) if end < 0 else end
        out.append(np.fromiter(map(crc32, low[at:end].split()), dtype=np.uint64))
        at = end
    return np.concatenate(out)


def shingle_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` words, from the hashes of the words."""
    n = max(0, len(codes) - width + 1)
    h = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        h ^= codes[k : k + n]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


def _probe(h: np.ndarray, j: int, bits: int) -> np.ndarray:
    step = h >> np.uint64(32) | np.uint64(1)
    return ((h & np.uint64(0xFFFFFFFF)) + np.uint64(j) * step) & np.uint64(bits - 1)


def fill(table: np.ndarray, h: np.ndarray) -> None:
    """Set the bits of some hashes; the table's size is a power of two."""
    for j in range(PROBES):
        p = _probe(h, j, 8 * len(table))
        np.bitwise_or.at(table, p >> np.uint64(3), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))


def held(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes have all their bits set, as places in ``h``."""
    at = np.arange(len(h))
    for j in range(PROBES):
        p = _probe(h[at], j, 8 * len(table))
        at = at[table[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & np.uint8(1) == 1]
    return at


def _windows(benchmark: DataFrame, size: int) -> DataFrame:
    """(window, items, width, shingles): each window's words, joined by spaces, the items that hold it, its shingles' hashes in order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, v in zip(batch.column(0).to_pylist(), views(batch.column(1)), strict=True):
                words = words_of(bytes(v))
                for at in range(0, max(1, len(words) - size + 1) if words else 0, CHUNK):
                    own = [b" ".join(w) for w in dict.fromkeys(windows_of(words[at : at + CHUNK + size - 1], size))]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(own), pa.string()), pa.array(own, pa.binary())], names=["item", "window"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [word_hashes(window) for window in batch.column(0).to_pylist()]
            widths = [min(SHINGLE, len(c)) for c in codes]
            own = [shingle_hashes(c, k).view(np.int64) for c, k in zip(codes, widths, strict=True)]
            cols = [*batch.columns, pa.array(widths, pa.int32()), pa.array(own, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["window", "items", "width", "shingles"])

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), text_bytes().alias("text"))
    by_window = rows.mapInArrow(cut, "item string, window binary").groupBy("window").agg(F.collect_set("item").alias("items"))
    return by_window.mapInArrow(hashed, "window binary, items array<string>, width int, shingles array<long>")


def bit_table(windows: DataFrame, most_bytes: int) -> np.ndarray:
    """The bits of all shingles: at most ``most_bytes`` (rounded down to a power of two), however many there are."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.unique(batch.column(0).flatten().to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([h.tobytes()], pa.binary())], names=["h"])

    n = windows.agg(F.sum(F.size("shingles"))).first()[0] or 0
    table = np.zeros(1 << min((max(n, 1) * BITS // 8 - 1).bit_length(), max(most_bytes, 1).bit_length() - 1), dtype=np.uint8)
    for row in windows.select("shingles").mapInArrow(pack, "h binary").toLocalIterator():
        fill(table, np.frombuffer(row.h, dtype=np.uint64))
    return table


def _plain(df: DataFrame) -> DataFrame:
    """The same columns by numbers for names: ``mapInArrow`` takes no names with dots."""
    return df.toDF(*map(str, range(len(df.columns))))


def _places(docs: DataFrame, row: str, places: str, table, widths: list[int]) -> DataFrame:
    """``docs`` with n_words, a number ``row`` of its own for each row, and ``places``: hash and place of the shingles that the table holds."""
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(f"{row} long, n_words long, {places} array<struct<h: long, at: int>>").fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for batch in sliced(batches):
            own = [word_hashes(bytes(v)) for v in views(batch.column(batch.num_columns - 1))]
            n = np.array([len(x) for x in own], dtype=np.int64)
            ends, codes = np.cumsum(n), np.concatenate([np.zeros(0, dtype=np.uint64), *own])
            doc, at, hashes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
            for width in widths:
                for first in range(0, len(codes) - width + 1, CHUNK):
                    h = shingle_hashes(codes[first : first + CHUNK + width - 1], width)
                    seen = held(bits, h)
                    in_doc = np.searchsorted(ends, seen + first, side="right")
                    whole = seen + first + width <= ends[in_doc]  # a shingle ends in the text it starts in
                    doc.append(in_doc[whole])
                    at.append((seen + first - ends[in_doc] + n[in_doc])[whole])
                    hashes.append(h[seen[whole]])
            doc = np.concatenate(doc)
            order = np.argsort(doc, kind="stable")
            cuts = np.searchsorted(doc[order], np.arange(batch.num_rows + 1)).astype(np.int32)
            pairs = pa.StructArray.from_arrays(
                [pa.array(np.concatenate(hashes)[order].view(np.int64)), pa.array(np.concatenate(at)[order].astype(np.int32))], names=["h", "at"]
            )
            cols = [*batch.columns[:-1], pa.array(n), pa.ListArray.from_arrays(pa.array(cuts), pairs)]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    names = [ddl_name(c) for c in docs.columns]
    return _plain(docs.select(*names, F.monotonically_increasing_id().alias(row), text_bytes().alias("_bytes"))).mapInArrow(work, schema)


def _prefixes(windows: DataFrame, places: DataFrame) -> DataFrame:
    """(h, off, window, items): each window by its rarest shingle in the corpus; ties go to the smaller hash, then the first place.

    A window with a shingle that no text has occurs nowhere and goes.
    """
    counts = places.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    shingles = windows.select("window", F.posexplode("shingles").alias("off", "h")).join(counts, "h", "left")
    rarest = shingles.groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "off")).alias("own")).where("own.n > 0")
    return rarest.join(windows.select("window", "items"), "window").select("own.h", "own.off", "window", "items")


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = 8, block_bytes: int = 64 << 20, finish: Callable | None = None
) -> DataFrame:
    """All columns of ``docs`` with n_words, ``hit_runs`` and ``items``.

    ``hit_runs`` are the merged runs of hit words, as [first, end) word numbers;
    ``items`` are the ids, as strings, of the items that occur, sorted. Null
    text has no words and nothing hits it; a null item id counts as ''; items
    without words have no windows; empty tables give no rows, or no hits.
    Columns of these names are replaced. Equal rows stay equal. The bit table
    that is broadcast takes at most ``block_bytes``; a benchmark too large for
    it costs more chance places, never a hit. ``finish`` gets the batches of
    the rows that may have hits, in the worker that compares them, and gives
    those returned; rows without hits must pass it unchanged.
    """
    finish = finish or (lambda batches: batches)
    docs = docs.drop("n_words", "hit_runs", "items")
    spark, names = docs.sparkSession, [ddl_name(c) for c in docs.columns]
    schema = T.StructType(
        [*docs.schema.fields, *T._parse_datatype_string("n_words long, hit_runs array<array<int>>, items array<string>").fields]
    )
    row, places = free_name(docs, "_row"), free_name(docs, "_places")
    windows = scratch(_windows(benchmark, size), "windows")
    widths = [r.width for r in windows.select("width").distinct().collect()]
    table = spark.sparkContext.broadcast(bit_table(windows, block_bytes))
    read = scratch(_places(docs, row, places, table, sorted(widths)), "decontam")
    table.unpersist()

    own = read.select(F.col(row).alias("row"), F.explode(places).alias("p")).select("row", "p.h", "p.at")
    prefixes = scratch(_prefixes(windows, own), "prefixes")
    starts = own.join(prefixes, "h").select("row", (F.col("at") - F.col("off")).alias("start"), "window", "items").where("start >= 0")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_window = starts.repartition(parts, "row").groupBy("row", "window").agg(F.first("items").alias("items"), F.collect_list("start").alias("starts"))
    marks = by_window.groupBy("row").agg(F.collect_list(F.struct("window", "items", "starts")).alias("marks"))
    marks = scratch(marks, "marks")
    drop_scratch(windows, prefixes)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            spans, items = [], []
            for v, marks in zip(views(batch.column(batch.num_columns - 1)), batch.column(batch.num_columns - 2).to_pylist(), strict=True):
                words = words_of(bytes(v))
                hit, found = bytearray(len(words)), set()
                for m in marks:
                    window = m["window"].split()
                    for start in m["starts"]:
                        if words[start : start + len(window)] == window:
                            hit[start : start + len(window)] = b"\x01" * len(window)
                            found.update(m["items"])
                spans.append([list(r) for r in runs(hit)])
                items.append(sorted(found))
            cols = [*batch.columns[:-2], pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    mark, key = free_name(docs, "_marks"), free_name(docs, "_key")
    marks = marks.select(F.col("row").alias(key), F.col("marks").alias(mark))
    some = F.size(places) > 0
    joined = read.where(some).join(marks, F.col(row) == F.col(key), "left")
    nothing = [F.array().cast(schema[c].dataType).alias(c) for c in ("hit_runs", "items")]
    may = joined.where(F.col(mark).isNotNull()).select(*names, "n_words", mark, text_bytes().alias("_bytes"))
    free = read.where(~some).unionAll(joined.where(F.col(mark).isNull()).select(*map(ddl_name, read.columns)))
    return _plain(may).mapInArrow(lambda x: finish(verify(x)), schema).unionAll(free.select(*names, "n_words", *nothing))


def with_digests(found: DataFrame, least: int = 2) -> DataFrame:
    """n_hit, n_items, the digest of the items and the verdict, from the operator's runs and items."""
    hit = F.aggregate("hit_runs", F.lit(0), lambda n, r: n + F.get(r, F.lit(1)) - F.get(r, F.lit(0)))
    return found.select(
        "doc_id",
        "n_words",
        hit.cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") >= least).alias("contaminated"),
    )


def cut_runs(text: str | None, spans: list) -> str | None:
    """A text without the words of ``spans`` and what stands between them."""
    if text is None or not spans:
        return text
    raw = text.encode()
    places = [m.span() for m in WORD.finditer(raw.translate(_KEEP))]
    out, at = [], 0
    for lo, hi in spans:
        out.append(raw[at : places[lo][0]])
        at = places[hi - 1][1]
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "replace")


def clean_documents(docs: DataFrame, benchmark: DataFrame, least: int = 2) -> DataFrame:
    """Documents without benchmark passages, with the columns of ``docs``.

    A document with windows of ``least`` items or more goes; from the others the
    hit words are cut out. Documents without hits stay as they are.
    """
    at = [c for c in docs.columns if c not in ("n_words", "hit_runs", "items")].index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.less(pc.list_value_length(batch.column("items")), least))
            spans = batch.column("hit_runs").to_pylist()
            texts = batch.column(at)
            if any(spans):
                texts = pa.array([cut_runs(t, s) for t, s in zip(texts.to_pylist(), spans, strict=True)], type=texts.type)
            yield batch.set_column(at, batch.schema.field(at), texts)

    found = find_contamination(docs, benchmark, finish=cut)
    if "n_chars" in docs.columns:
        size = F.when(F.size("hit_runs") > 0, F.length("text")).otherwise(F.col("n_chars"))
        found = found.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType))
    return found.select(*map(ddl_name, docs.columns))
