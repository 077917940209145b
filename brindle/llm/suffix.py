"""Removal of long repeated byte strings by enhanced suffix arrays.

Distributed part. Every string of ``length`` bytes has an anchor: the least
hash among its 32-byte grams. Equal strings have equal anchors at equal places,
so strings that share no anchor need no comparison. Starts that follow one
another and share an anchor occurrence make a segment; a segment that occurs
twice is settled by its 128-bit hash, and only segments that share an anchor
with a different one are fetched as bytes, once for all their copies.

Local part. The segments of an anchor meet in one suffix array (prefix
doubling), with the common prefixes of neighbours; a stack scan walks the
common-prefix interval tree and reports each interval whose occurrences differ
on the left: the maximal repeats, each with all its occurrences.

An anchor with more than ``group_limit`` different segments is dealt out by the
bytes that all strings of a block of starts have in common, so that no task
gets a whole frequent passage with all its surroundings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import ddl_name, drop_scratch, scratch, sliced, text_bytes, views

GRAM = 32
BLOCK = 64
_PLACE = 24
_CHUNK = 1 << 20
DIVERSE = -1


def anchors(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last start of each segment, its anchor's place and hash."""
    n = len(text)
    out = []
    for at in range(0, max(1, n - length + 1), _CHUNK):
        part = np.frombuffer(text, dtype=np.uint8, offset=at, count=min(n - at, _CHUNK + length - 1))
        if len(part) < length:
            break
        out.append(_anchors(part, length, at))
    if not out:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, empty
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _anchors(part: np.ndarray, length: int, at: int):
    n = len(part)
    word = np.ndarray(shape=(n - 7,), dtype="<u8", buffer=part, strides=(1,))
    grams = n - GRAM + 1
    h = word[:grams] * np.uint64(0x9E3779B97F4A7C15)
    for k in (8, 16, 24):
        h ^= h >> np.uint64(29)
        h += word[k : k + grams]
        h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    low = (h & np.uint64(~((1 << _PLACE) - 1) & (1 << 64) - 1)) | np.arange(grams, dtype=np.uint64)
    width, size = length - GRAM + 1, 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    place = (low & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    last = np.append(first[1:], len(place)) - 1
    place = place[first]
    return first + at, last + at, place + at, h[place].view(np.int64)


def suffix_ranks(symbols: np.ndarray, left: np.ndarray, limit: int) -> list[tuple[int, np.ndarray]]:
    """(prefix length, ranks of all suffixes by that prefix), doubling from 7 until ``limit`` is reached.

    ``symbols`` are bytes plus one; 7 zeros end each string; ``left`` is the
    number of bytes from a place to its string's end. Suffixes already alone
    are not sorted again.
    """
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(7, dtype=symbols.dtype)]).astype(np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(7):
        key = (key << np.uint64(9)) | padded[k : k + n]
    order = np.argsort(key)
    ordered = key[order]
    head = np.append(True, ordered[1:] != ordered[:-1])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
    levels, size = [(7, rank.astype(np.int32))], 7
    active = order[~(head & np.append(head[1:], True))]
    while size < limit and len(active):
        after = np.minimum(active + size, n - 1)
        second = np.where(left[active] > size, rank[after] + 1, 0)
        key = (rank[active].astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        by = np.argsort(key)
        ordered, active = key[by], active[by]
        head = np.append(True, ordered[1:] != ordered[:-1])
        group = np.append(True, (ordered[1:] >> np.uint64(32)) != (ordered[:-1] >> np.uint64(32)))
        place = np.arange(len(active))
        inside = place - np.maximum.accumulate(np.where(group, place, 0))
        new = (ordered >> np.uint64(32)).astype(np.int64) + inside
        rank = rank.copy()
        rank[active] = new[np.flatnonzero(head)][np.cumsum(head) - 1]
        active = active[~(head & np.append(head[1:], True))]
        size *= 2
        levels.append((size, rank.astype(np.int32)))
    return levels


def common_prefixes(levels, a: np.ndarray, b: np.ndarray, symbols: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Length of the common prefix of suffixes a[i] and b[i], from the ranks of each doubling."""
    a, b = a.copy(), b.copy()
    out = np.zeros(len(a), dtype=np.int64)
    n = len(symbols)
    for size, rank in reversed(levels):
        inside = (a < n) & (b < n)
        x, y = np.minimum(a, n - 1), np.minimum(b, n - 1)
        same = inside & (rank[x] == rank[y]) & (symbols[x] > 0)
        step = np.where(same, np.minimum(size, left[x]), 0)
        a, b, out = a + step, b + step, out + step
    for _ in range(6):
        x, y = np.minimum(a, n - 1), np.minimum(b, n - 1)
        same = (symbols[x] == symbols[y]) & (symbols[x] > 0)
        a, b, out = a + same, b + same, out + same
    return out


def maximal_repeats(prefixes: list[int], before: list[int]) -> Iterator[tuple[int, int, int]]:
    """Stack scan of one run of the suffix array: (length, first, last) of each left-diverse interval.

    ``prefixes[i]`` is the common prefix of entries i and i+1; ``before[i]`` the
    symbol before entry i, or a negative number of its own at a string's start.
    """
    stack: list[list[int]] = []
    for i, prefix in enumerate([*prefixes, 0]):
        first, symbol = i, before[i]
        while stack and stack[-1][0] > prefix:
            size, lo, own = stack.pop()
            symbol = own if own == symbol else DIVERSE
            if symbol == DIVERSE:
                yield size, lo, i
            first = lo
        if stack and stack[-1][0] == prefix:
            if stack[-1][2] != symbol:
                stack[-1][2] = DIVERSE
        elif prefix:
            stack.append([prefix, first, symbol])


def repeat_groups(strings: list[bytes], starts: list[int], length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Maximal repeats of ``length`` or more among several strings.

    Only the first ``starts[i]`` places of string i may start an occurrence.
    Gives (length, numbers of the strings, places in them): all occurrences.
    """
    for size, _, numbers, places in _repeats(strings, starts, length):
        yield size, numbers, places


def _repeats(strings, starts, length):
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    base = np.cumsum(sizes + 7) - (sizes + 7)
    symbols = np.zeros(int((sizes + 7).sum()), dtype=np.uint16)
    raw = np.frombuffer(b"".join(strings), dtype=np.uint8)
    places = np.arange(len(raw)) + np.repeat(base - (np.cumsum(sizes) - sizes), sizes)
    symbols[places] = raw.astype(np.uint16) + 1
    left = np.zeros(len(symbols), dtype=np.int64)
    left[places] = np.repeat(base + sizes, sizes) - places
    levels = suffix_ranks(symbols, left, 2 * length)
    n_starts = np.array(starts, dtype=np.int64)
    owner = np.repeat(np.arange(len(strings)), n_starts)
    suffix = np.arange(len(owner)) + np.repeat(base - (np.cumsum(n_starts) - n_starts), n_starts)
    order = np.argsort(levels[-1][1][suffix], kind="stable")
    suffix, owner = suffix[order], owner[order]
    prefix = common_prefixes(levels, suffix[:-1], suffix[1:], symbols, left)
    before = np.where(suffix > base[owner], symbols[np.maximum(suffix - 1, 0)].astype(np.int64), -2 - owner)
    linked = np.concatenate([[False], prefix >= length, [False]])
    first = np.flatnonzero(~linked[:-1] & linked[1:])
    last = np.flatnonzero(linked[:-1] & ~linked[1:])
    differ = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
    for lo, hi in zip(first.tolist(), last.tolist(), strict=True):
        if differ[hi] == differ[lo]:
            continue  # one symbol stands before all: each longer repeat starts further left
        for size, a, b in maximal_repeats(prefix[lo:hi].tolist(), before[lo : hi + 1].tolist()):
            at = slice(lo + a, lo + b + 1)
            yield size, at, owner[at], suffix[at] - base[owner[at]]


def repeated_starts(strings: list[bytes], starts: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For each string, merged runs [first, last] of starts whose ``length`` bytes occur elsewhere too."""
    runs: list[list[tuple[int, int]]] = [[] for _ in strings]
    best: dict[tuple[int, int], int] = {}
    for size, numbers, places in repeat_groups(strings, starts, length):
        for key in zip(numbers.tolist(), places.tolist(), strict=True):
            if best.get(key, 0) < size:
                best[key] = size
    for (i, place), size in best.items():
        runs[i].append((place, min(place + size - length, starts[i] - 1)))
    return [merge(r) for r in runs]


def merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(runs):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


_SEGMENT = "t1 long, t2 long, lo int, hi int, place int, h long, s1 long, s2 long"


def _halves(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:16], "little", signed=True)


def _keyed(docs: DataFrame, *columns: str) -> DataFrame:
    raw = text_bytes()
    return docs.select(
        *columns, F.xxhash64(raw).alias("t1"), F.xxhash64(F.lit("second"), raw).alias("t2"), raw.alias("_bytes")
    )


def _segments(docs: DataFrame, length: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([*T._parse_datatype_string(_SEGMENT).fields, T.StructField("did", kind)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in sliced(batches):
            rows, counts = [], []
            for v in views(batch.column(3)):
                if len(v) < length:
                    counts.append(0)
                    continue
                lo, hi, place, h = anchors(v, length)
                seg = b"".join([digest(v[a:b]) for a, b in zip(lo.tolist(), (hi + length).tolist(), strict=True)])
                rows.append((lo, hi, place, h, np.frombuffer(seg, dtype="<i8").reshape(-1, 2)))
                counts.append(len(lo))
            if not rows:
                continue
            take = pa.array(np.repeat(np.arange(len(counts)), counts))
            lo, hi, place, h, seg = (np.concatenate(x) for x in zip(*rows, strict=True))
            cols = [batch.column(1).take(take), batch.column(2).take(take)]
            cols += [pa.array(x.astype(np.int32)) for x in (lo, hi, place)]
            cols += [pa.array(h), pa.array(seg[:, 0].copy()), pa.array(seg[:, 1].copy()), batch.column(0).take(take)]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return _keyed(docs, "doc_id").mapInArrow(work, schema)


def _fetched(docs: DataFrame, needs: DataFrame, length: int, group_limit: int) -> DataFrame:
    """The bytes of segments that must be compared, keyed by the group they are compared in."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for v, wanted in zip(views(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                for w in wanted:
                    lo, hi, at, own = w["lo"], w["hi"], w["place"], (w["s1"], w["s2"])
                    if w["m"] <= group_limit:
                        out.append((w["h"], *own, *own, 0, hi - lo + 1, w["n"], bytes(v[lo : hi + length])))
                        continue
                    for j in range((at - hi) // BLOCK, (at - lo) // BLOCK + 1):
                        a, b = max(lo, at - BLOCK * j - BLOCK + 1), min(hi, at - BLOCK * j)
                        core = bytes(v[at - BLOCK * j : at - BLOCK * j - BLOCK + 1 + length])
                        key = xxhash.xxh3_64_intdigest(core, seed=(w["h"] + j) & (1 << 64) - 1)
                        span = bytes(v[a : b + length])
                        out.append((key - (1 << 64) * (key >> 63), *_halves(xxhash.xxh3_128_digest(span)), *own, a - lo, b - a + 1, w["n"], span))
            if out:
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64()] * 5 + [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)], names=names)

    names = ["g", "u1", "u2", "s1", "s2", "base", "starts", "n", "body"]
    source = _keyed(docs, F.col("doc_id").alias("_did"))
    on = (source.t1 == needs.k1) & (source.t2 == needs.k2) & source["_did"].eqNullSafe(needs.did)
    joined = source.join(needs, on).select("_bytes", "wanted")
    return joined.mapInArrow(work, "g long, u1 long, u2 long, s1 long, s2 long, base int, starts int, n long, body binary")


def _compared(fetched: DataFrame, length: int, batch_bytes: int = 1 << 18) -> DataFrame:
    """(s1, s2, a, b): runs of starts, from each segment's first, that repeat."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings: list[bytes] = []
        starts: list[int] = []
        owners: list[list[tuple]] = []
        used, group, last = 0, None, None

        def flush() -> Iterator[pa.RecordBatch]:
            out = []
            found = repeated_starts(strings, starts, length) if len(strings) > 1 else [[] for _ in strings]
            for runs, own, n in zip(found, owners, starts, strict=True):
                if len({o[:2] for o in own}) > 1:
                    runs = [(0, n - 1)]
                out += [(s1, s2, base + a, base + b) for s1, s2, base, count in own if count < 2 for a, b in runs]
            if out:
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)], names=["s1", "s2", "a", "b"])

        for batch in sliced(batches, 2000):
            g, u1, u2, s1, s2, base, n_starts, n = (batch.column(i).to_pylist() for i in range(8))
            for i, v in enumerate(views(batch.column(8))):
                if g[i] != group:
                    if used >= batch_bytes:
                        yield from flush()
                        strings, starts, owners, used = [], [], [], 0
                    group, last = g[i], None
                if (u1[i], u2[i]) != last:
                    last = (u1[i], u2[i])
                    strings.append(bytes(v))
                    starts.append(n_starts[i])
                    owners.append([])
                    used += len(v)
                owners[-1].append((s1[i], s2[i], base[i], n[i]))
        yield from flush()

    parts = int(fetched.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = fetched.repartition(parts, "g").sortWithinPartitions("g", "u1", "u2")
    return dealt.mapInArrow(work, "s1 long, s2 long, a int, b int")


def find_repeats(docs: DataFrame, length: int = 400, group_limit: int = 1000) -> DataFrame:
    """(t1, t2, runs): per distinct text, runs [first, last] of starts of strings that occur elsewhere too.

    Aggregates are written before the joins that read them: Spark splits a hot
    key only between plain exchanges. What no later step reads is dropped.
    """
    raw = scratch(_segments(docs, length), "segments")
    shared = scratch(raw.groupBy(F.col("h").alias("_h")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h"), "anchors")
    met = raw.join(shared, F.col("h") == F.col("_h"), "left_semi")
    keys = ["hi", "place", "h", "s1", "s2", "did"]
    once = scratch(met.groupBy("t1", "t2", "lo").agg(F.count(F.lit(1)).alias("c"), *[F.min(k).alias(k) for k in keys]), "places")
    drop_scratch(raw, shared)
    where = ["h", "t1", "t2", "did", "lo", "hi", "place"]
    segments = once.groupBy("s1", "s2").agg(F.sum("c").alias("n"), *[F.first(k).alias(k) for k in where])
    segments = scratch(segments, "distinct")
    crowd = scratch(segments.groupBy(F.col("h").alias("_h")).agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "crowds")
    detail = segments.join(crowd, F.col("h") == F.col("_h"))
    wanted = F.struct("lo", "hi", "place", "h", "s1", "s2", "n", "m")
    needs = detail.groupBy(F.col("t1").alias("k1"), F.col("t2").alias("k2"), "did").agg(F.collect_list(wanted).alias("wanted"))
    fetched = scratch(_fetched(docs, needs, length, group_limit), "edges")
    local = _compared(fetched, length)
    settled = segments.where("n > 1").select("s1", "s2", F.lit(0).alias("a"), (F.col("hi") - F.col("lo")).alias("b"))
    marks = scratch(settled.unionByName(local), "marks")
    drop_scratch(segments, crowd, fetched)
    runs = once.select("t1", "t2", "lo", "s1", "s2").join(marks, ["s1", "s2"])
    run = F.struct((F.col("lo") + F.col("a")).alias("a"), (F.col("lo") + F.col("b")).alias("b"))
    runs = scratch(runs.groupBy(F.col("t1").alias("k1"), F.col("t2").alias("k2")).agg(F.collect_list(run).alias("runs")), "runs")
    drop_scratch(once, marks)
    return runs


def remove_repeats(docs: DataFrame, length: int = 400, group_limit: int = 1000, choose: Callable | None = None) -> DataFrame:
    """The columns of ``docs`` but the text, with ``removed`` ([first, end) byte runs), ``kept`` (bytes) and ``n_bytes``.

    A byte goes if a string of ``length`` bytes over it also starts anywhere
    else, in the same text or another; all is judged on the input. Null text
    counts as empty; texts shorter than ``length`` stay whole; equal texts
    (repeated rows too) repeat each other; null doc_ids are allowed; an empty
    table gives no rows. Columns of these names are replaced. ``choose`` gets a
    text's bytes and its runs, and gives the runs that are cut.
    """
    rest = [c for c in docs.columns if c not in ("text", "removed", "kept", "n_bytes")]
    more = T._parse_datatype_string("removed array<array<int>>, kept binary, n_bytes long").fields
    schema = T.StructType([*[docs.schema[c] for c in rest], *more])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            removed, kept, size = [], [], []
            for v, runs in zip(views(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                spans = spans_of([(r["a"], r["b"]) for r in runs or []], length)
                if choose and spans:
                    spans = choose(v, spans)
                removed.append(spans)
                kept.append(without(v, spans))
                size.append(len(v))
            more = [pa.array(removed, pa.list_(pa.list_(pa.int32()))), pa.array(kept, pa.binary()), pa.array(size, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.column(0).flatten(), *more], names=schema.names)

    runs = find_repeats(docs, length, group_limit)
    # The other columns travel as one struct, so none of their names can clash.
    source = _keyed(docs, F.struct(*[F.col(ddl_name(c)) for c in rest]).alias("_doc"))
    joined = source.join(runs, (source.t1 == runs.k1) & (source.t2 == runs.k2), "left")
    return joined.select("_doc", "_bytes", "runs").mapInArrow(work, schema)


def spans_of(runs: list[tuple[int, int]], length: int) -> list[list[int]]:
    """Byte runs [first, end) covered by strings that start in ``runs``; touching runs are one."""
    return [[a, b + 1] for a, b in merge([(a, b + length - 1) for a, b in runs])]


def without(text, spans: list[list[int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(bytes(text[at:a]))
        at = b
    out.append(bytes(text[at:]))
    return b"".join(out)


def with_digests(removed: DataFrame) -> DataFrame:
    """Sizes, number of runs and digest of what is left, from the operator's runs and bytes."""
    gone = F.aggregate("removed", F.lit(0), lambda n, r: n + F.get(r, F.lit(1)) - F.get(r, F.lit(0)))
    return removed.select(
        "doc_id", "n_bytes", gone.cast("long").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def passages(text, spans: list[list[int]], least_words: int, least_bytes: int) -> list[list[int]]:
    """The runs with ``least_words`` words or ``least_bytes`` bytes, widened to whole characters; overlapping ones are one."""
    chosen = []
    for a, b in spans:
        if b - a < least_bytes and len(bytes(text[a:b]).split()) < least_words:
            continue
        while a > 0 and text[a] & 0xC0 == 0x80:
            a -= 1
        while b < len(text) and text[b] & 0xC0 == 0x80:
            b += 1
        chosen.append((a, b - 1))
    return [[a, b + 1] for a, b in merge(chosen)]


def trim_documents(docs: DataFrame, length: int = 240, least_words: int = 50, least_bytes: int = 400) -> DataFrame:
    """Documents without their repeated passages, with the columns of ``docs``.

    A passage is a run of repeated strings of ``length`` bytes that has
    ``least_words`` words, or ``least_bytes`` bytes where words are longer or
    not parted. Texts without one stay as they are (null too). A cut inside a
    character takes the whole character.
    """
    renamed = docs.withColumn("_text", F.col("text"))
    out = remove_repeats(renamed, length, choose=lambda text, spans: passages(text, spans, least_words, least_bytes))
    cut = F.size("removed") > 0
    out = out.withColumn("text", F.when(cut, F.col("kept").cast("string")).otherwise(F.col("_text")))
    if "n_chars" in docs.columns:
        size = F.when(cut, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
