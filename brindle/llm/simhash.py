"""SimHash fingerprints, linked by multi-index hashing, and their components.

Two 64-bit fingerprints at distance 3 or less differ by at most 1 bit in one of
their 32-bit halves. So each half is a table key, and each fingerprint looks up
its Hamming ball of radius 1 there (33 keys a half); what meets in a bucket is
verified on all 64 bits. Equal fingerprints count once. A bucket returns a
spanning forest of its links, never all pairs.

``keep_one`` looks farther: five-word shingles of similarity 0.8 differ in
about 58 of 384 bits. Its fingerprints have 13 segments of 28 bits; every
fingerprint is entered under its whole ball of radius 1 in each segment, so two
meet where a segment differs by 2 bits or fewer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import ddl_name, drop_scratch, scratch, sliced, text_bytes, views

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
SEED = 42


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """The hashes of the ``width``-word shingles, repeats included; fewer words are one shingle."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, dtype="<u8")
    joined = memoryview(b" ".join(words))
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    if len(words) > width:
        lo, hi = (ends - sizes)[: 1 - width or None].tolist(), ends[width - 1 :].tolist()
    else:
        lo, hi = [0], [len(joined)]
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], SEED) for a, b in zip(lo, hi, strict=True)], dtype="<u8")


def fingerprint(text: bytes, width: int = 3) -> int:
    """A bit is 1 if set in over half the hashes of the ``width``-word shingles, repeats included."""
    hashes = shingle_hashes(text, width)
    total = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes), bitorder="little").tobytes(), "little")


#: Words of a wide fingerprint, its segments, and the bits of each.
WORDS, SEGMENTS, SEGMENT_BITS = 6, 13, 28
NAMES = [f"w{k}" for k in range(WORDS)]


def wide_fingerprint(text: bytes, width: int = 5) -> np.ndarray:
    """WORDS * 64 bits; each shingle's hash is mixed anew for each word."""
    hashes = shingle_hashes(text, width)
    seeds = np.arange(1, 2 * WORDS, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    total = np.zeros(64 * WORDS, dtype=np.int64)
    for k in range(0, len(hashes), 255):
        x = hashes[k : k + 255, None] + seeds
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        bits = np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little")
        total += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")


def with_fingerprints(docs: DataFrame, width: int = 3, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default doc_id) and ``fingerprint`` as a signed long. Null text has no words: 0."""
    keep = keep or ["doc_id"]
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("fingerprint", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            prints = np.array([fingerprint(bytes(v), width) for v in views(batch.column(len(keep)))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(prints.view(np.int64))], names=schema.names)

    return docs.select(*keep, text_bytes().alias("_bytes")).mapInArrow(work, schema)


class Forest:
    """Union by path halving; ``join`` says if the edge is new."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def bucket_links(owners: np.ndarray, probes: np.ndarray, limit: int, block: int = 1024) -> list[tuple[int, int]]:
    """A spanning forest of the links between ``owners`` and owners or probes of one bucket.

    Pairs are verified a block at a time, so memory is bounded whatever the
    bucket holds. Owners share one half exactly; where there are more than a
    Hamming ball of the other half could hold, balls are looked up instead, and
    the work stays in proportion to the bucket.
    """
    everyone = np.concatenate([owners, probes])
    forest, out = Forest(len(everyone)), []

    def join(a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            if forest.join(i, j):
                out.append((int(everyone[i]), int(everyone[j])))

    if len(everyone) > 50_000:
        _balls(everyone, len(owners), limit, join)
        return out
    for i in range(0, len(owners), block):
        mine = owners[i : i + block]
        for j in range(i, len(everyone), block * 4):
            near = np.bitwise_count(mine[:, None] ^ everyone[None, j : j + block * 4]) <= limit
            a, b = np.nonzero(near)
            a, b = a + i, b + j
            fresh = b > a
            join(a[fresh], b[fresh])
    return out


def _balls(everyone: np.ndarray, n_owners: int, limit: int, join) -> None:
    """Look up every owner's ball among the sorted members: masks of up to ``limit`` bits."""
    from itertools import combinations

    order = np.argsort(everyone, kind="stable")
    ordered = everyone[order]
    mine = np.arange(n_owners)
    for r in range(limit + 1):
        for bits in combinations(range(64), r):
            mask = np.uint64(sum(1 << b for b in bits))
            wanted = everyone[:n_owners] ^ mask
            at = np.minimum(np.searchsorted(ordered, wanted), len(ordered) - 1)
            met = ordered[at] == wanted
            a, b = mine[met], order[at[met]]
            join(a[a != b], b[a != b])


def fingerprint_links(prints: DataFrame, limit: int = 3) -> DataFrame:
    """Links (a, b) between distinct fingerprints at ``limit`` bits or fewer, enough to connect all that are linked.

    ``prints`` has one column of distinct signed longs. Each row gives 66 short
    rows (its own key and 32 neighbours in each half), sorted by key in the
    JVM; a task holds one bucket at a time.
    """
    if not 0 <= limit <= 3:
        raise ValueError("two halves with balls of radius 1 find up to 3 bits")

    def enumerate_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = np.concatenate([[0], 1 << np.arange(32)]).astype(np.uint64)
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(whole), 4096):
                p = whole[k : k + 4096]
                low, high = p & np.uint64(0xFFFFFFFF), p >> np.uint64(32)
                keys = np.concatenate([(low[:, None] ^ flips).ravel(), ((high[:, None] ^ flips) | np.uint64(1 << 32)).ravel()])
                prints_ = np.tile(np.repeat(p, 33), 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(prints_.view(np.int64))], names=["key", "fp"]
                )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(key: int, members: list[np.ndarray]) -> list[tuple[int, int]]:
            fps = np.concatenate(members)
            if len(fps) < 2:
                return []
            half = (fps >> np.uint64(32)) if key >> 32 else fps & np.uint64(0xFFFFFFFF)
            own = half == np.uint64(key & 0xFFFFFFFF)
            return bucket_links(fps[own], fps[~own], limit) if own.any() else []

        open_key, members = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            edges = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.append(0, edges), np.append(edges, len(keys))
            found = []
            # Buckets of one fingerprint need no look: only the first and last of a batch, and longer ones.
            look = np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(keys)))
            for i in look.tolist():
                key = int(keys[starts[i]])
                if key != open_key:
                    if members:
                        found += close(open_key, members)
                    open_key, members = key, []
                members.append(fps[starts[i] : ends[i]])
            if found:
                yield _links(found)
        if members and (found := close(open_key, members)):
            yield _links(found)

    keys = prints.mapInArrow(enumerate_keys, "key long, fp long")
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.repartition(parts, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(verify, "a long, b long")


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(found, dtype=np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the least node of each connected component, for nodes with links.

    Rounds of star contraction: every node points to the least of its
    neighbours and itself, alternately for greater and for all neighbours; the
    longest path halves, so rounds grow with its logarithm. Each round is a
    table in the shared folder; sums are made before the shuffle.
    """
    edges = scratch(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(max_rounds):
        # Large star: greater neighbours of each node go to its least neighbour or itself.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # The least ones are written first, so that Spark can split the edges of a centre.
        least = scratch(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: smaller neighbours and the node itself go to the least of them.
        low = large.distinct()
        lowest = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(lowest, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            lowest.select("a", F.col("m").alias("b"))
        )
        new = scratch(small.where("a <> b").distinct(), "links")
        state = new.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        drop_scratch(edges, least)
        edges = new
        if before == state:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 3, limit: int = 3, extra: list[str] | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable) and ``component``
    (one fingerprint of the component, the same for all its rows) of every row.

    Null text and texts without words have fingerprint zero and are linked like
    any other; repeated rows each keep a row; a null doc_id is never the least
    unless all are null; an empty table gives no rows. Columns ``extra`` come along.
    """
    keep = ["doc_id", *(extra or [])]
    prints = scratch(with_fingerprints(docs, width, keep), "simhash")
    distinct = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("_least"))
    distinct = scratch(distinct, "fingerprints")
    roots = components(fingerprint_links(distinct.select("fingerprint"), limit))
    linked = distinct.join(roots, F.col("fingerprint") == F.col("node"), "left")
    linked = linked.withColumn("_root", F.coalesce("root", "fingerprint")).select("fingerprint", "_least", "_root")
    least = linked.groupBy("_root").agg(F.min("_least").alias("component_id"))
    by_print = linked.join(least, "_root").select(F.col("fingerprint").alias("_fp"), "component_id", "_root")
    # A fingerprint may stand for a third of all rows; the other side has one row for it, so the join can be split.
    joined = prints.join(by_print, F.col("fingerprint") == F.col("_fp"), "left")
    digits = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return joined.select(*keep, digits("fingerprint").alias("fingerprint"), "component_id", digits("_root").alias("component"))


def _segments(prints: np.ndarray) -> np.ndarray:
    """The segments of each row of words, as numbers."""
    bits = np.unpackbits(prints.view(np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")
    bits = bits[:, : SEGMENTS * SEGMENT_BITS].reshape(len(prints), SEGMENTS, SEGMENT_BITS)
    return bits @ (1 << np.arange(SEGMENT_BITS, dtype=np.int64))


def spanning_links(ids: np.ndarray, prints: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within a bucket.

    The first member not yet reached is compared with all others not yet
    reached; those within ``limit`` bits are reached, and each has its turn
    before the next member starts a tree. A dense group takes a few turns, not
    all pairs; memory is in proportion to the bucket.
    """
    order = np.argsort(ids)
    ids, prints = ids[order], prints[order]
    rest, out = np.arange(len(ids)), []
    while len(rest):
        turn, rest = [rest[0]], rest[1:]
        while turn and len(rest):
            pivot = turn.pop()
            near = np.bitwise_count(prints[rest] ^ prints[pivot]).sum(axis=1) <= limit
            if near.any():
                met = rest[near]
                out += [(int(ids[pivot]), int(ids[i])) for i in met]
                turn += met.tolist()
                rest = rest[~near]
    return out


def wide_links(prints: DataFrame, limit: int) -> DataFrame:
    """Links (a, b) between the ids of fingerprints at ``limit`` bits or fewer that meet in a bucket, enough to connect them.

    ``prints`` has an ``id`` and the words of distinct fingerprints. Each row
    gives SEGMENTS * (SEGMENT_BITS + 1) rows, sorted by key in the JVM; a task
    holds one bucket at a time.
    """

    def enumerate_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = np.concatenate([[0], 1 << np.arange(SEGMENT_BITS)])
        table = np.arange(SEGMENTS, dtype=np.int64)[None, :, None] << SEGMENT_BITS
        for batch in sliced(batches, 512):
            words = [c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
            keys = table | (_segments(np.stack(words, axis=1))[:, :, None] ^ flips)
            take = np.repeat(np.arange(batch.num_rows), keys[0].size)
            cols = [c.to_numpy(zero_copy_only=False)[take] for c in batch.columns]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys.ravel(), *cols)], names=["key", "id", *NAMES])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(members: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
            ids, rows = (np.concatenate(x) for x in zip(*members, strict=True))
            return spanning_links(ids, rows, limit) if len(ids) > 1 else []

        open_key, members = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            edges = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.append(0, edges), np.append(edges, len(keys))
            # Buckets of one fingerprint need no look: only the first and last of a batch, and longer ones.
            look = np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(keys)))
            words, found = [c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]], []
            for i in look.tolist():
                at = slice(starts[i], ends[i])
                if (key := int(keys[starts[i]])) != open_key:
                    if members:
                        found += close(members)
                    open_key, members = key, []
                members.append((ids[at], np.stack([w[at] for w in words], axis=1).view(np.uint64)))
            if found:
                yield _links(found)
        if members and (found := close(members)):
            yield _links(found)

    words = ", ".join(f"{n} long" for n in NAMES)
    keys = prints.select("id", *NAMES).mapInArrow(enumerate_keys, f"key long, id long, {words}")
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(verify, "a long, b long")


def keep_one(docs: DataFrame, width: int = 5, limit: int = 66) -> DataFrame:
    """One document of each component, the one with the least doc_id, with the columns of ``docs``.

    66 of 384 bits stand for a similarity of about 0.77, so that few pairs of
    0.8 or more are missed. A document is known by 128 bits over its text and
    id; of rows that share both, one stays. Documents without words are equal;
    null text counts as empty; an empty table gives no rows. The texts are
    shuffled once and not copied.
    """
    raw = text_bytes()
    keyed = docs.select(
        F.struct(*[F.col(ddl_name(c)) for c in docs.columns]).alias("_doc"),
        "doc_id",
        raw.alias("_bytes"),
        F.xxhash64(raw).alias("_k1"),
        F.xxhash64(F.lit("second"), raw, F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("_k2"),
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            prints = np.stack([wide_fingerprint(bytes(v), width) for v in views(batch.column(3))]).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(x) for x in prints.T.copy()]], names=["doc_id", "_k1", "_k2", *NAMES])

    schema = T.StructType([keyed.schema[c] for c in ("doc_id", "_k1", "_k2")] + [T.StructField(n, T.LongType()) for n in NAMES])
    prints = scratch(keyed.select("doc_id", "_k1", "_k2", "_bytes").mapInArrow(work, schema), "simhash")
    distinct = scratch(prints.select(*NAMES).distinct().withColumn("id", F.monotonically_increasing_id()), "fingerprints")
    roots = components(wide_links(distinct, limit))
    root = F.coalesce("root", "id").alias("_root")
    by_print = distinct.join(roots, F.col("id") == F.col("node"), "left").select(*[F.col(n).alias(f"_{n}") for n in NAMES], root)
    by_print = scratch(by_print, "components")
    grouped = prints.join(by_print, [F.col(n) == F.col(f"_{n}") for n in NAMES])
    first = F.min_by(F.struct("_k1", "_k2"), F.struct(F.col("doc_id").isNull(), "doc_id", "_k1", "_k2"))
    best = scratch(grouped.groupBy("_root").agg(first.alias("_best")).select("_best.*"), "chosen")
    drop_scratch(prints, distinct, by_print)
    chosen = keyed.select("_doc", "_k1", "_k2").join(best, ["_k1", "_k2"], "left_semi")
    one = F.row_number().over(W.partitionBy("_k1", "_k2").orderBy(F.xxhash64("_doc")))
    return chosen.withColumn("_n", one).where("_n = 1").select("_doc.*")
