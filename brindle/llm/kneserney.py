"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The model is over characters (any code point, order 5). Its counts cover every
trusted document and are summed in shards by n-gram; lower orders count distinct
left neighbours; joins on an n-gram's context and its shorter form give its
interpolated probability. Nothing of the model is broadcast or collected.

Documents are scored by joins, too. A block is a range of rows of a file; a task
lists the distinct n-grams of each of its blocks, these are joined to the
model's shards, and each block's texts meet the probabilities of their own
n-grams again. Thresholds are quantiles of the trusted documents' perplexity, by
language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import drop_scratch, scratch, sliced, text_bytes, views

ORDER = 5
#: Stands before and after a text, and for the character 0: code points that no text has.
EDGE, NIL = 0xFFFF, 0xFFFE
#: Rows of a file that make a block, and characters that are looked up at a time.
BLOCK_ROWS, CHUNK = 4096, 1 << 19


class Slots:
    """Open addressing over 64-bit hashes, for whole arrays at once."""

    def __init__(self, bits: int = 16):
        self.bits, self.n = bits, 0
        self.keys = np.zeros(1 << bits, dtype=np.uint64)
        self.values = np.zeros(1 << bits, dtype=np.float32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each hash (none is 0) its slot, or the free slot where its search ended, and whether it is there."""
        mask = len(self.keys) - 1
        slot = (h & np.uint64(mask)).astype(np.int64)  # the low bits: hashes often come in order
        here = self.keys[slot]
        found = here == h
        open_ = np.flatnonzero(~found & (here != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & mask
            here = self.keys[slot[open_]]
            found[open_] = here == h[open_]
            open_ = open_[(here != 0) & (here != h[open_])]
        return slot, found

    def add(self, h: np.ndarray, values: np.ndarray | float = 0.0) -> None:
        """Put in different hashes that are not there yet."""
        while (self.n + len(h)) * 4 > len(self.keys):
            old = np.flatnonzero(self.keys)
            bigger = Slots(self.bits + 2)
            bigger._put(self.keys[old], self.values[old])
            self.bits, self.keys, self.values = bigger.bits, bigger.keys, bigger.values
        self._put(h, np.broadcast_to(np.asarray(values, dtype=np.float32), h.shape))
        self.n += len(h)

    def _put(self, h: np.ndarray, values: np.ndarray) -> None:
        while len(h):
            slot, _ = self.find(h)
            slot, first = np.unique(slot, return_index=True)
            self.keys[slot], self.values[slot] = h[first], values[first]
            rest = np.ones(len(h), dtype=bool)
            rest[first] = False
            h, values = h[rest], values[rest]


def code_points(text) -> np.ndarray:
    """A byte text as code points, with ORDER - 1 edges before it and one after."""
    body = np.frombuffer(bytes(text).decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    out = np.full(len(body) + ORDER, EDGE, dtype=np.uint32)
    out[ORDER - 1 : -1] = body
    out[out == 0] = NIL
    return out


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each n-gram of the highest order; never 0."""
    mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    n = len(codes) - ORDER + 1
    h = mixed[:n].copy()
    for k in range(1, ORDER):
        h *= np.uint64(0x94D049BB133111EB)
        h += mixed[k : k + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return np.maximum(h, np.uint64(1))


def grams_at(codes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The n-grams at some places as texts."""
    return np.ascontiguousarray(codes[places[:, None] + np.arange(ORDER)]).view(f"<U{ORDER}").ravel()


def chunks(texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Code points of the texts, one text after the other, about CHUNK at a time, and the places of their n-grams.

    A long text is cut so that each of its n-grams lies in one piece; no n-gram reaches into another text.
    """
    held, size = [], 0

    def put_together():
        codes = np.concatenate(held)
        own = np.ones(len(codes), dtype=bool)
        ends = np.cumsum([len(x) for x in held])
        own[(ends[:, None] - np.arange(1, ORDER)).ravel()] = False
        return codes, np.flatnonzero(own)

    for t in texts:
        codes = code_points(t)
        for at in range(0, len(codes) - ORDER + 1, CHUNK):
            held.append(codes[at : at + CHUNK + ORDER - 1])
            size += len(held[-1])
            if size >= CHUNK:
                yield put_together()
                held, size = [], 0
    if held:
        yield put_together()


def count_grams(trusted: DataFrame) -> DataFrame:
    """(gram, n) of the highest order; each task sends what a chunk has summed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, places in chunks(v for batch in batches for v in views(batch.column(0))):
            _, first, n = np.unique(gram_hashes(codes)[places], return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams_at(codes, places[first])), pa.array(n)], names=["gram", "n"])

    return trusted.select(text_bytes()).mapInArrow(work, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> list[float]:
    """The three discounts of modified Kneser-Ney, from how many n-grams occur once to four times."""
    have = {r["n"]: r["k"] for r in counts.where("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()}
    n1, n2, n3, n4 = (have.get(i, 0) for i in (1, 2, 3, 4))
    if not (n1 and n2):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)]


def train(trusted: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1: (gram, own) and (context, gamma).

    ``own`` is the discounted share of the gram's last character after the
    others; ``gamma`` the weight that a context leaves to the shorter one.
    """
    by_order = {ORDER: scratch(count_grams(trusted), "kn-counts")}
    for k in range(ORDER - 1, 0, -1):
        # Continuation counts: how many different characters stand before the shorter gram.
        shorter = by_order[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        by_order[k] = scratch(shorter, "kn-counts")
    model = []
    for k in range(1, ORDER + 1):
        counts, d = by_order[k], discounts(by_order[k])
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        rows = counts.withColumn("context", F.substring("gram", 1, k - 1)).withColumn("cut", F.least(cut, F.col("n")))
        totals = scratch(rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum("cut").alias("spare")), "kn-contexts")
        own = rows.join(totals, "context").select("gram", ((F.col("n") - F.col("cut")) / F.col("total")).alias("own"))
        model.append((scratch(own, "kn-grams"), totals.select("context", (F.col("spare") / F.col("total")).alias("gamma"))))
    drop_scratch(*by_order.values())
    return model


def probabilities(grams: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(gram, p) of distinct n-grams of the highest order, seen or not, by joins with the model's shards, order by order.

    The shortest model is uniform over the trusted characters and one for all others.
    """
    wanted = {ORDER: scratch(grams, "kn-wanted")}
    for k in range(ORDER - 1, 0, -1):
        wanted[k] = scratch(wanted[k + 1].select(F.substring("gram", 2, k).alias("gram")).distinct(), "kn-wanted")
    lower = None
    for k in range(1, ORDER + 1):
        own, left = model[k - 1]
        rows = wanted[k].withColumn("context", F.substring("gram", 1, k - 1)).join(own, "gram", "left").join(left, "context", "left")
        if lower is None:
            rows = rows.withColumn("low", F.lit(1.0 / (own.count() + 1)))
        else:
            low = lower.select(F.col("gram").alias("_g"), F.col("p").alias("low"))
            rows = rows.join(low, F.substring("gram", 2, k - 1) == F.col("_g"))
        p = F.coalesce("own", F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * F.col("low")
        lower, before = scratch(rows.select("gram", p.alias("p")), "kn-model"), lower
        if before is not None:
            drop_scratch(before)
    drop_scratch(*wanted.values())
    return lower


def _blocks(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_block``: which file, and which thousands of its rows.

    It depends on the files alone, so every scan and every repeated task gives a
    row the same block. What is not read from files is written first.
    """
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = scratch(docs, "kn-docs")
    where = F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / BLOCK_ROWS))
    return docs.select("doc_id", "lang", text_bytes().alias("_bytes"), where.alias("_block"))


def block_grams(rows: DataFrame) -> DataFrame:
    """(block, gram, h): the distinct n-grams of each block and their hashes. A task reads a block's rows in a row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seen = None, Slots()
        for batch in batches:
            blocks = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in _runs(blocks):
                if blocks[a] != block:
                    block, seen = blocks[a], Slots()
                for codes, places in chunks(views(batch.column(1).slice(a, b - a))):
                    h = gram_hashes(codes)[places]
                    new = np.flatnonzero(~seen.find(h)[1])
                    h, first = np.unique(h[new], return_index=True)
                    seen.add(h)
                    out = [np.full(len(h), block), grams_at(codes, places[new[first]]), h.view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["block", "gram", "h"])

    return rows.select("_block", "_bytes").mapInArrow(work, "block long, gram string, h long")


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """First and end of each run of equal keys."""
    edges = (np.flatnonzero(np.diff(keys)) + 1).tolist()
    return list(zip([0, *edges], [*edges, len(keys)], strict=True)) if len(keys) else []


def block_tables(pairs: DataFrame, scored: DataFrame) -> DataFrame:
    """(block, body): hashes and log probabilities of each block's n-grams, packed, in pieces."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            blocks, h, p = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            logs, cuts = np.log(p).astype("<f4"), _runs(blocks)
            body = [h[a:b].tobytes() + logs[a:b].tobytes() for a, b in cuts]
            yield pa.RecordBatch.from_arrays([pa.array(blocks[[a for a, _ in cuts]]), pa.array(body, pa.binary())], names=["block", "body"])

    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = pairs.join(scored, "gram").select("block", "h", "p").repartition(parts, "block").sortWithinPartitions("block")
    return joined.mapInArrow(work, "block long, body binary")


def with_perplexity(docs: DataFrame, model: list[tuple[DataFrame, DataFrame]], rounds: int = 3) -> DataFrame:
    """doc_id, lang and ``perplexity``, a character, of each whole text.

    The blocks are worked off in ``rounds``, so that shuffle files take only a
    part of the disk that the texts would.
    """
    rows = _blocks(docs)
    schema = T.StructType([docs.schema["doc_id"], docs.schema["lang"], T.StructField("perplexity", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, table = None, Slots()
        for batch in sliced(batches):
            keys, is_text = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            out = np.full(batch.num_rows, np.nan)
            for i, body in enumerate(views(batch.column(2))):
                if keys[i] != block:
                    block, table = keys[i], Slots()
                if not is_text[i]:
                    n = len(body) // 12
                    table.add(np.frombuffer(body, dtype="<u8", count=n), np.frombuffer(body, dtype="<f4", offset=8 * n))
                    continue
                total = count = 0
                for codes, places in chunks([body]):
                    slot, found = table.find(gram_hashes(codes)[places])
                    if not found.all():
                        raise RuntimeError("a text has n-grams that its block has not listed")
                    total += float(table.values[slot].sum(dtype=np.float64))
                    count += len(slot)
                out[i] = np.exp(-total / count)
            kept = pa.array(is_text.astype(bool))
            cols = [batch.column(3).filter(kept), batch.column(4).filter(kept), pa.array(out).filter(kept)]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done = []
    for k in range(rounds):
        own = rows.where(F.pmod("_block", F.lit(rounds)) == k)
        pairs = scratch(block_grams(own), "kn-pairs")
        scored = probabilities(pairs.select("gram").distinct(), model)
        tables = scratch(block_tables(pairs, scored), "kn-tables")
        drop_scratch(pairs, scored)
        nothing = [F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in ("doc_id", "lang")]
        both = own.select(F.col("_block").alias("block"), F.lit(1).alias("is_text"), F.col("_bytes").alias("body"), "doc_id", "lang").unionAll(
            tables.select("block", F.lit(0).alias("is_text"), "body", *nothing)
        )
        dealt = both.repartition(parts, "block").sortWithinPartitions("block", "is_text")
        done.append(scratch(dealt.mapInArrow(work, schema), "kn-scores"))
        drop_scratch(tables)
    out = done[0]
    for part in done[1:]:
        out = out.unionAll(part)
    return out


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.98, margin: float = 0.15) -> DataFrame:
    """doc_id, lang, perplexity, threshold and kept of every document.

    Trusted text is that of every document labelled quality 1. A document is
    kept if its perplexity is at most (1 + ``margin``) times its language's
    ``quantile`` among trusted documents, and no less than the mirrored bound
    (text that repeats itself is too easy); a language without trusted
    documents takes the bounds of all. Null text counts as empty; a null
    language is one more; repeated rows are scored alike; without trusted text
    nothing is rejected; an empty table gives no rows.
    """
    good = scratch(labels.where("quality = 1").select("doc_id").distinct(), "trusted")
    # A merge at every size: the ids grow with the labels, and Spark can split a hot key.
    trusted = docs.select("doc_id", "text").join(good.hint("merge"), "doc_id", "left_semi")
    scored = with_perplexity(docs, train(trusted))
    known = scored.join(good, "doc_id", "left_semi")
    bounds = F.percentile_approx("perplexity", [1 - quantile, quantile], 1000)
    by_lang = known.groupBy(F.col("lang").alias("_lang")).agg(bounds.alias("_own"))
    overall = known.agg(bounds.alias("_all"))
    joined = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")), "left").join(F.broadcast(overall), how="left")
    pair = F.coalesce("_own", "_all")
    high, low = pair[1] * (1 + margin), pair[0] / (1 + margin)
    kept = F.coalesce(F.col("perplexity").between(low, high), F.lit(True))
    return joined.select("doc_id", "lang", "perplexity", high.alias("threshold"), kept.alias("kept"))
