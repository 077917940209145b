"""Substring dedup by sliding sentence spans.

From every sentence starts a span: the fewest consecutive sentences that have
``least_words`` words together. Every span is hashed (128 bits); spans meet by
hash across the whole corpus; sentences covered by a span that is not the first
of its kind go. First is by document key, then by place. A text with fewer
words is one span as a whole, which only such texts can equal.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import ddl_name, drop_scratch, scratch, sliced, views

#: A sentence ends after . ! ? (and what closes it) before white space, or at a line's end.
END = re.compile(rb"[.!?][\"')\]]*\s+|\n\s*")
LEAST_WORDS = 20


def sentences(text: bytes) -> list[tuple[int, int]]:
    """Runs [first, end) of bytes that together are the whole text; white space belongs to the sentence before it."""
    ends = [m.end() for m in END.finditer(text)]
    if len(text) and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    return list(zip([0, *ends], ends, strict=False))


def spans_of(text: bytes, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First sentence and end of each span, and its 128-bit hash (int64 pairs), white space at sentences' ends aside."""
    parts = [text[a:b].strip() for a, b in sentences(text)]
    words = np.concatenate([[0], np.cumsum([len(p.split()) for p in parts], dtype=np.int64)])
    end = np.searchsorted(words, words[:-1] + least_words)
    first = np.flatnonzero(end <= len(parts))
    end = end[first]
    if not len(first) and words[-1]:
        first, end = np.zeros(1, dtype=np.int64), np.array([len(parts)])
    digest = xxhash.xxh3_128_digest
    hashes = b"".join(digest(b"\n".join(parts[a:b])) for a, b in zip(first.tolist(), end.tolist(), strict=True))
    return first.astype(np.int32), end.astype(np.int32), np.frombuffer(hashes, dtype="<i8").reshape(-1, 2)


def find_spans(docs: DataFrame, least_words: int) -> DataFrame:
    """(h1, h2, row, place, end) of every span. ``docs`` has ``_row``, the order of documents, and ``_bytes``."""
    names = ["h1", "h2", "row", "place", "end"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [spans_of(bytes(v), least_words) for v in views(batch.column(1))]
            if not found:
                continue
            first, end, both = (np.concatenate(x) for x in zip(*found, strict=True))
            rows = batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(x[0]) for x in found])))
            cols = [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), rows, pa.array(first), pa.array(end)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select("_row", "_bytes").mapInArrow(work, "h1 long, h2 long, row long, place int, end int")


def remove_repeated_spans(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The columns of ``docs`` with the text cut, ``n_sentences`` and ``n_removed``.

    The first occurrence, by doc_id (nulls last) and then place, stays. Null
    text stays null; a text without words has no span; of repeated rows one is
    first; an empty table gives no rows. Columns named like the counts are
    replaced.
    """
    docs = docs.drop("n_sentences", "n_removed")
    # The document travels as one struct, so none of its names can clash.
    whole = F.struct(*[F.col(ddl_name(c)) for c in docs.columns]).alias("_doc")
    numbered = scratch(docs.select(whole, F.monotonically_increasing_id().alias("_row")), "span-docs")
    text = F.coalesce(F.col("_doc")["text"].cast("string"), F.lit("")).cast("binary")
    spans = scratch(find_spans(numbered.select("_row", text.alias("_bytes")), least_words), "spans")
    ids = numbered.select(F.col("_row").alias("row"), F.col("_doc")["doc_id"].alias("doc_id"))
    # Aggregates are written before the joins that read them: Spark splits a hot key only between plain exchanges.
    several = scratch(spans.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "span-hashes")
    repeated = scratch(spans.join(several, ["h1", "h2"], "left_semi").join(ids, "row"), "repeated-spans")
    drop_scratch(spans, several)
    first = repeated.groupBy("h1", "h2").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "place")).alias("first")
    )
    first = scratch(first, "first-spans")
    later = repeated.join(first, ["h1", "h2"]).where("row <> first.row or place <> first.place")
    marks = scratch(later.groupBy("row").agg(F.collect_list(F.struct("place", "end")).alias("runs")), "span-marks")
    drop_scratch(repeated, first)
    columns = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())])
    at = columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts, counts, gone = [], [], []
            cols = batch.column(0).flatten()
            for text, found in zip(cols[at].to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode()
                runs = sentences(raw)
                drop = bytearray(len(runs))
                for r in found or []:
                    drop[r["place"] : r["end"]] = b"\x01" * (r["end"] - r["place"])
                texts.append(b"".join(raw[a:b] for (a, b), d in zip(runs, drop, strict=True) if not d).decode() if any(drop) else text)
                counts.append(len(runs))
                gone.append(sum(drop))
            cols[at] = pa.array(texts, type=cols[at].type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], names=schema.names)

    joined = numbered.join(marks, F.col("_row") == F.col("row"), "left")
    return joined.select("_doc", "runs").mapInArrow(cut, schema)
