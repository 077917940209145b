"""Harmonic packing of token pieces into sequences of a fixed capacity.

Piece lengths fall into reciprocal-capacity classes: class k holds lengths in
(capacity/(k+1), capacity/k], and a bin of class k always takes exactly k
pieces. Each worker fills its own bins while it reads its documents, so there is
no shuffle and no shared state.

Documents may be cut freely, and the cuts are chosen for the classes: a
document gives full sequences first, then pieces of halved lengths (capacity/2,
/4 … down to ``shortest``), which fill their classes' bins without a gap, and
one tail shorter than ``shortest``, whose class wastes under 1/16 of a bin. When a worker
ends, its unfinished bins hold less than one bin a class; those pieces are
packed together, longest first.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LETTER, NUMBER, SPACE, OTHER, END = range(5)
#: One code point above Unicode: ends each document of a batch. Those after it stand for added tokens.
STOP = 0x110000
#: Endings that split from a word after an apostrophe: fixed values of the tokenizer.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
BATCH_CHARS = 1 << 19


@functools.cache
def _classes() -> np.ndarray:
    """The class of each code point, from Unicode's properties."""
    import regex

    table = np.full(STOP + 1, OTHER, dtype=np.uint8)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, STOP)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for run in regex.finditer(pattern, everything):
            lo, hi = ord(run[0][0]), ord(run[0][-1])
            if hi - lo + 1 == len(run[0]):
                table[lo : hi + 1] = kind
            else:
                table[[ord(c) for c in run[0]]] = kind
    table[STOP] = END
    return table


def piece_starts(chars: np.ndarray) -> np.ndarray:
    """Where the tokenizer's own splitting starts a new piece, over documents that end in STOP.

    An added token is one code point above STOP and parts what is around it.

    A piece is a run of letters, of numbers or of other signs, with one space
    before it if there is one; a run of white space without that last character;
    or an apostrophe with one of ENDINGS.
    """
    kind = _classes()[np.minimum(chars, STOP)]
    change = np.empty(len(kind), dtype=bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change[kind == END] = True
    solid = kind <= NUMBER
    solid |= kind == OTHER
    start = change.copy()
    # The last character of a white-space run before a solid run stands alone, or leads that run.
    after_space = np.flatnonzero(change[1:] & solid[1:] & (kind[:-1] == SPACE)) + 1
    start[after_space - 1] = True
    led = after_space[chars[after_space - 1] == 0x20]
    start[led] = False
    # Endings after an apostrophe that starts a piece.
    marks = np.flatnonzero((chars[:-1] == 0x27) & start[:-1] & (kind[1:] == LETTER))
    if len(marks):
        padded = np.concatenate([chars, np.zeros(4, dtype=chars.dtype)])
        open_marks = np.ones(len(marks), dtype=bool)
        for ending in ENDINGS:
            fits = open_marks.copy()
            for j, c in enumerate(ending):
                fits &= padded[marks + 1 + j] == ord(c)
            at = marks[fits]
            start[at + 1] = False
            after = at + 1 + len(ending)
            start[after[kind[np.minimum(after, len(kind) - 1)] == LETTER]] = True
            open_marks &= ~fits
    return np.flatnonzero(start)


class Encoder:
    """Token ids of many texts at once, with a store of pieces already seen.

    Pieces meet by a 64-bit polynomial hash over mixed code points that their length enters as
    well, and their code points are compared; unseen ones, and those that share another's hash, are
    encoded by the tokenizer's own ranks. The store is emptied when it exceeds ``limit`` pieces. With ``added``, the file's added tokens
    get their own ids wherever they stand, as the tokenizer's default has it; else they are plain text.
    """

    def __init__(self, path: str, limit: int = 300_000, added: bool = False):
        self.limit = limit
        self.added = _added_tokens(path) if added else {}
        longest = sorted(self.added, key=len, reverse=True)
        self.marks = re.compile("|".join(map(re.escape, longest))) if longest else None
        self.mark = {t: STOP + 1 + i for i, t in enumerate(self.added)}
        self.mark_ids = list(self.added.values())
        self.known: dict[int, int] = {}
        self.encode = _piece_encoder(path)
        odd = pow(0x9E3779B97F4A7C15, 1, 1 << 64)
        self.base, self.inverse = odd, pow(odd, -1, 1 << 64)
        self.powers = self.unpowers = np.ones(1, dtype=np.uint64)
        self._clear()

    def _clear(self) -> None:
        self.known.clear()
        self.flat: list[np.ndarray] = [np.zeros(1, dtype=np.uint32)]
        self.ids = np.zeros(1, dtype=np.uint32)
        self.start = np.zeros(1, dtype=np.int64)
        self.size = np.ones(1, dtype=np.int64)
        # The code points of each stored piece; the first is the end of a text.
        self.points = np.array([STOP], dtype=np.uint32)
        self.from_, self.length = np.zeros(1, dtype=np.int64), np.ones(1, dtype=np.int64)

    def _grow(self, n: int) -> None:
        if len(self.powers) <= n:
            steps = np.full(n + 1, self.base, dtype=np.uint64)
            steps[0] = 1
            self.powers = np.cumprod(steps)
            steps[1:] = self.inverse
            self.unpowers = np.cumprod(steps)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by 0, and the end of each text in them."""
        parts = []
        stop = np.array([STOP], dtype=np.uint32)
        for t in texts:
            at = 0
            for m in self.marks.finditer(t) if self.marks else ():
                parts += [_code_points(t[at : m.start()]), np.array([self.mark[m[0]]], dtype=np.uint32)]
                at = m.end()
            parts += [_code_points(t[at:] if at else t), stop]
        chars = np.concatenate(parts)
        starts = piece_starts(chars)
        ends = np.append(starts[1:], len(chars))
        self._grow(len(chars))
        mixed = chars.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0x94D049BB133111EB)
        sums = np.zeros(len(chars) + 1, dtype=np.uint64)
        np.cumsum(mixed * self.powers[: len(chars)], out=sums[1:])
        code = (sums[ends] - sums[starts]) * self.unpowers[starts]
        code += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        code, first, which = np.unique(code, return_index=True, return_inverse=True)
        if len(self.known) + len(code) > self.limit:
            self._clear()
        lo, length = starts[first], (ends - starts)
        place = np.array([self.known.get(k, -1) for k in code.tolist()], dtype=np.int64)
        hit = np.flatnonzero(place >= 0)
        own = length[first]
        clash = _differ(chars, lo[hit], own[hit], self.points, self.from_[place[hit]], self.length[place[hit]])
        place[hit[clash]] = -1
        new = np.flatnonzero(place < 0)
        place[new] = self._store(chars, lo[new], own[new])
        self.known.update(zip(code[new].tolist(), place[new].tolist(), strict=True))
        pieces = place[which]
        # Within a batch each piece must be its representative, too.
        shift = np.repeat((lo[which] - starts).astype(np.int32), length)
        shift += np.arange(len(chars), dtype=np.int32)
        unequal = chars != chars.take(shift, mode="clip")
        clash = length != own[which]
        if unequal.any() or clash.any():
            clash |= np.logical_or.reduceat(unequal, starts)
            pieces[clash] = self._store(chars, starts[clash], length[clash])
        size = self.size[pieces]
        run = np.cumsum(size)
        ids = self.ids[np.repeat(self.start[pieces] - (run - size), size) + np.arange(run[-1])]
        return ids, run[pieces == 0]

    def _store(self, chars: np.ndarray, lo: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Places of pieces that are encoded now."""
        place = np.zeros(len(lo), dtype=np.int64)
        new = np.flatnonzero(chars[lo] != STOP)
        lo, length = lo[new], length[new]
        if not len(new):
            return place
        first = np.cumsum(length) - length
        points = chars[np.arange(int(length.sum())) + np.repeat(lo - first, length)]
        text = np.where(points > STOP, 0x20, points).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        encode = self.encode
        ids = [encode(text[a:b]) for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
        for j in np.flatnonzero(points[first] > STOP).tolist():
            ids[j] = [self.mark_ids[int(points[first[j]]) - STOP - 1]]
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        place[new] = len(self.size) + np.arange(len(ids))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(ids), dtype=np.uint32, count=int(size.sum()))])
        self.from_ = np.concatenate([self.from_, len(self.points) + first])
        self.length = np.concatenate([self.length, length])
        self.points = np.concatenate([self.points, points])
        return place


def _differ(a: np.ndarray, a_start, a_length, b: np.ndarray, b_start, b_length) -> np.ndarray:
    """Which of the pieces of ``a`` are not the pieces of ``b`` at the same number."""
    out = a_length != b_length
    look = np.flatnonzero(~out)
    if len(look):
        n = a_length[look]
        first = np.cumsum(n) - n
        step = np.arange(int(n.sum()))
        unequal = a[step + np.repeat(a_start[look] - first, n)] != b[step + np.repeat(b_start[look] - first, n)]
        out[look] = np.add.reduceat(unequal, first, dtype=np.int64) > 0
    return out


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a tokenizer file and their ids."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f).get("added_tokens") or []
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in tokens):
        raise ValueError("added tokens that take white space or need whole words are not supported")
    return {t["content"]: t["id"] for t in tokens}


def _piece_encoder(path: str):
    """Encodes one piece by the ranks in a tokenizer file.

    The file's byte-level vocabulary is read back to bytes (its alphabet follows
    a rule); its ids are the merge ranks, so the merges need no second table.
    Where they are not, the tokenizer itself encodes.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    letters |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in letters)}
    to_byte = {c: b for b, c in letters.items()}
    vocab = {t: i for t, i in model["vocab"].items() if all(c in to_byte for c in t)}
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    merged = [vocab.get(a + b, -1) for a, b in pairs]
    special = [t for t in model["vocab"] if t.startswith("<|")]
    if merged == sorted(merged) and merged[:1] != [-1]:
        import tiktoken

        ranks = {bytes(to_byte[c] for c in t): i for t, i in vocab.items() if t not in special}
        own = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        return own.encode_ordinary
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    return lambda piece: whole.encode(piece, add_special_tokens=False).ids


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One a worker process: pieces seen by one task serve the next."""
    return Encoder(path, added=True)


def cuts(n: int, capacity: int, shortest: int) -> list[int]:
    """Lengths of the pieces of ``n`` tokens, in order."""
    whole, rest = divmod(n, capacity)
    out = [capacity] * whole
    size = capacity // 2
    while rest and size >= shortest:
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    return out + [rest] * (rest > 0)


class Bins:
    """One worker's open bins: class k holds fewer than k pieces at any time."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.open: dict[int, list[tuple]] = defaultdict(list)

    def add(self, piece: tuple) -> list[tuple]:
        """The pieces of the bin that this one fills, placed; else nothing."""
        k = self.capacity // piece[2]
        own = self.open[k]
        own.append(piece)
        return self._place(self.open.pop(k)) if len(own) == k else []

    def _place(self, pieces: list[tuple]) -> list[tuple]:
        at, out = 0, []
        for p in pieces:
            out.append((*p, self.next, at))
            at += p[2]
        self.next += 1
        return out

    def close(self) -> Iterator[tuple]:
        """Place what is left, longest first, each where it still fits."""
        bins: list[list] = []
        for p in sorted((p for own in self.open.values() for p in own), key=lambda p: -p[2]):
            for b in bins:
                if b[0] + p[2] <= self.capacity:
                    b[0] += p[2]
                    b[1].append(p)
                    break
            else:
                bins.append([p[2], [p]])
        for _, pieces in bins:
            yield from self._place(pieces)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, shortest: int = 64) -> DataFrame:
    """Pieces of all documents with their place: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` holds unsigned little-endian 32-bit ids. Null and empty texts are
    one piece of the closing id 0. Repeated rows and null doc_ids are packed
    like any other; an empty table gives no rows; other columns are not read.
    ``tokenizer`` must be readable at the same path on every worker.
    sequence_id is unique across workers: the partition's number above 2^33.
    """
    if capacity & (capacity - 1) or shortest < 1:
        raise ValueError("capacity must be a power of two and shortest positive")
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [
            T.StructField("doc_id", kind), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()),
            T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
        ]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        bins = Bins(capacity, TaskContext.get().partitionId() << 33)
        id_type = None

        def rows(placed: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*placed, strict=True))
            types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            order = [0, 1, 2, 3, 4, 5, 6]
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[i], type=t) for i, t in zip(order, types, strict=True)], names=schema.names
            )

        for batch in batches:
            id_type = batch.schema.field(0).type
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in _chunks(texts):
                ids, ends = encode(texts[lo:hi])
                raw, at, out = ids.astype("<u4").tobytes(), 0, []
                for key, end in zip(keys[lo:hi], ends.tolist(), strict=True):
                    n, start = end - at, 0
                    for size in cuts(n, capacity, shortest):
                        b = 4 * (at + start)
                        out += bins.add((key, start, size, raw[b : b + 4 * size], n))
                        start += size
                    at = end
                if out:
                    yield rows(out)
        if left := list(bins.close()):
            yield rows(left)

    source = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return source.mapInArrow(work, schema)


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    lo = chars = 0
    for i, t in enumerate(texts):
        chars += len(t) + 1
        if chars >= BATCH_CHARS:
            yield lo, i + 1
            lo, chars = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def with_digests(packed: DataFrame) -> DataFrame:
    """The packing as the checksum of each piece's ids instead of the ids."""
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
