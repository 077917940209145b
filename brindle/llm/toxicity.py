"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features: densities of a lexicon (whole words and word beginnings) learned from
labels, how close its hits stand to a second person, capitals, punctuation and
obfuscation. At most ``max_rows`` labelled rows, the least by a hash of their
id, fit the model; they are split in three: for the lexicon, the trees and the
calibration. Every whole text is scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile(r"[^\W_]+")
#: Words of the second person: fixed values.
SECOND = frozenset(
    "you your yours yourself u ur du dich dir dein deine euch euer ihr sie tu toi te ton ta tes vous votre vos usted ustedes tú ti tus su vosotros".split()
)
CAPITALS = re.compile(r"\b[^\W\d_a-z]{3,}\b")
MIXED = re.compile(r"[^\W\d_][0-9@$*!#|]+[^\W\d_]|([^\W\d_])\1{3,}")
SPACED = re.compile(r"(?:\b[^\W\d_][ .*-]){3,}[^\W\d_]\b")
PREFIXES = (4, 5, 6)
FEATURES = (
    "hit_density", "hit_weight", "hits", "top_weight", "hit_kinds", "near_second", "second_density",
    "capital_ratio", "capital_words", "exclaim", "punctuation", "obfuscated", "spaced", "log_words",
)


@dataclass
class Lexicon:
    """Weights of whole words and of word beginnings; ``heads`` are the first letters of any of them."""

    words: dict[str, float] = field(default_factory=dict)
    starts: dict[str, float] = field(default_factory=dict)
    heads: set[str] = field(default_factory=set)

    @classmethod
    def of(cls, words: dict[str, float], starts: dict[str, float]) -> Lexicon:
        return cls(words, starts, {w[:4] for w in [*words, *starts]})

    def weight(self, word: str) -> float:
        best = self.words.get(word, 0.0)
        for k in PREFIXES:
            if len(word) > k:
                best = max(best, self.starts.get(word[:k], 0.0))
        return best


def features(text: str, lexicon: Lexicon) -> list[float]:
    lowered = WORD.findall(text.lower())
    n = max(1, len(lowered))
    heads = lexicon.heads
    hits = [(i, lexicon.weight(w)) for i, w in enumerate(lowered) if w[:4] in heads]
    hits = [(i, x) for i, x in hits if x > 0]
    second = [i for i, w in enumerate(lowered) if w in SECOND]
    near = 0
    if hits and second:
        places = np.array(second)
        at = np.array([i for i, _ in hits])
        j = np.searchsorted(places, at)
        gap = np.minimum(np.abs(at - places[np.maximum(j - 1, 0)]), np.abs(at - places[np.minimum(j, len(places) - 1)]))
        near = int((gap <= 5).sum())
    size = max(1, len(text))
    letters = max(1, sum(map(len, lowered)))
    upper = sum(1 for a in text if "A" <= a <= "Z") if len(text) < 64 else int(_uppers(text))
    marks = text.count("!") + text.count("?")
    return [
        len(hits) / n, sum(x for _, x in hits) / n, float(len(hits)), max((x for _, x in hits), default=0.0),
        float(len({lowered[i] for i, _ in hits})), near / n, len(second) / n, upper / letters,
        len(CAPITALS.findall(text)) / n, marks / size, (size - letters - text.count(" ")) / size,
        len(MIXED.findall(text)) / n, len(SPACED.findall(text)) / n, float(np.log1p(len(lowered))),
    ]


def _uppers(text: str) -> int:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    return ((raw >= 65) & (raw <= 90)).sum()


def learn_lexicon(sample: DataFrame, least: int = 4, size: int = 2000) -> Lexicon:
    """Words and beginnings that toxic documents hold far more often than others.

    Document counts are summed on the executors; at most ``size`` entries, those
    in most toxic documents, come to the driver.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(WORD.findall((text or "").lower()))
                counts[toxic].update(words)
                counts[toxic].update({w[:k] + "*" for w in words for k in PREFIXES if len(w) > k})
        keys = list(counts[0].keys() | counts[1].keys())
        cols = [pa.array(keys, pa.string()), pa.array([counts[0][k] for k in keys], pa.int64()), pa.array([counts[1][k] for k in keys], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["token", "clean", "toxic"])

    counted = sample.select("text", "toxic").mapInArrow(work, "token string, clean long, toxic long")
    sums = counted.groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    a, b = totals.get(1, 0), totals.get(0, 0)
    if not a:
        return Lexicon()
    odds = F.log((F.col("toxic") + 0.5) / (a + 1.0)) - F.log((F.col("clean") + 0.5) / (b + 1.0))
    top = sums.where(F.col("toxic") >= least).withColumn("weight", odds).where("weight > 2").orderBy(F.desc("toxic"), "token").limit(size).collect()
    words = {r["token"]: r["weight"] for r in top if not r["token"].endswith("*")}
    starts = {r["token"][:-1]: r["weight"] for r in top if r["token"].endswith("*")}
    return Lexicon.of(words, starts)


@dataclass
class Trees:
    """Boosted regression trees on the logistic loss; nodes lie in arrays, level by level."""

    bias: float
    rate: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    depth: int = 3

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += self.rate * value[at - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 2.0) -> Trees:
    """Fit on binned features; each level takes, per node, the split that lowers the second-order loss most."""
    prior = (y.sum() + 0.5) / (len(y) + 1.0)
    model = Trees(float(np.log(prior / (1 - prior))), rate, depth=depth)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])] if len(x) else []
    if not len(x):
        return model
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    score = np.full(len(x), model.bias)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        inner = 2**depth - 1
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        at = np.zeros(len(x), dtype=np.int64)
        for level in range(depth):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                mine = np.flatnonzero(at == node)
                best = 1e-6
                for j, e in enumerate(edges):
                    if not len(mine) or not len(e):
                        continue
                    gs = np.cumsum(np.bincount(binned[mine, j], g[mine], bins + 1))
                    hs = np.cumsum(np.bincount(binned[mine, j], h[mine], bins + 1))
                    left_g, left_h = gs[: len(e)], hs[: len(e)]
                    gain = left_g**2 / (left_h + ridge) + (gs[-1] - left_g) ** 2 / (hs[-1] - left_h + ridge) - gs[-1] ** 2 / (hs[-1] + ridge)
                    k = int(np.argmax(gain))
                    if gain[k] > best:
                        best, feature[node], cut[node] = gain[k], j, e[k]
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > cut[at])
        leaf = at - inner
        value = -np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        model.trees.append((feature, cut, value))
        score += rate * value[leaf]
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (score, probability) of the best non-decreasing fit."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([s, v, 1.0])
        while len(blocks) > 1 and (blocks[-2][1] >= blocks[-1][1]):
            s2, v2, w2 = blocks.pop()
            s1, v1, w1 = blocks.pop()
            blocks.append([(s1 * w1 + s2 * w2) / (w1 + w2), (v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2])
    if not blocks:
        return np.array([0.0]), np.array([0.0])
    return np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])


def held_out(column: str = "doc_id"):
    """Whether a row never teaches: the checksum of its id as text is a multiple of five."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 16_000):
    """(lexicon, trees, calibration) from at most ``max_rows`` labelled rows that are not held out."""
    usable = labels.where(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    one = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64(F.lit("toxicity"), "doc_id")
    chosen = one.withColumn("_h", order).orderBy("_h", "doc_id").limit(max_rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.withColumn("_part", F.pmod("_h", F.lit(10)))
    from brindle.llm.common import drop_scratch, scratch

    texts = scratch(texts.repartition(8, "doc_id"), "toxic-sample")
    lexicon = learn_lexicon(texts.where("_part < 5"))
    rows = with_features(texts.where("_part >= 5").select("toxic", "_part", "text"), lexicon).toArrow()
    drop_scratch(texts)
    x = np.array(rows.column("_x").to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    y, part = rows.column("toxic").to_numpy().astype(float), rows.column("_part").to_numpy()
    trees = boost(x[part < 8], y[part < 8])
    return lexicon, trees, isotonic(trees.raw(x[part >= 8]), y[part >= 8])


def with_features(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """All columns but ``text``, which comes last, and the feature vector ``_x``."""
    keep = [c for c in docs.columns if c != "text"]
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("_x", T.ArrayType(T.DoubleType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t or "", lexicon) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(x, pa.list_(pa.float64()))], names=schema.names)

    return docs.select(*keep, "text").mapInArrow(work, schema)


def score_documents(docs: DataFrame, labels: DataFrame, max_rows: int = 16_000) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Null text counts as empty and is scored like it; a null doc_id has the
    checksum of ''; repeated rows get equal scores; without labels every score
    is 0; an empty table gives no rows; other columns are not read.
    """
    lexicon, trees, (knots, level) = fit(docs, labels, max_rows)
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, trees, knots, level))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, trees, knots, level = shared.value
        for batch in batches:
            x = np.array([features(t or "", lexicon) for t in batch.column(1).to_pylist()], dtype=float).reshape(-1, len(FEATURES))
            score = np.interp(trees.raw(x), knots, level)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=schema.names)

    scored = docs.select("doc_id", "text").mapInArrow(work, schema)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
