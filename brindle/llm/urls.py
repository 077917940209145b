"""URL filter: rules first, then a ratio of two character language models.

Where a rule fits, its verdict holds. Those URLs are also the examples: two
smoothed variable-order Markov models, one of allowed and one of blocked URLs,
are counted over all of them, over any character. Other URLs get the difference
of the two log-likelihoods a symbol, judged against a threshold calibrated on
the histograms of all decided URLs. A decided URL is scored by models of the
other half of them, so no URL is judged by a model that has counted it.

Counts, probabilities and scores are joins on n-grams; nothing of the models is
collected or broadcast by hand, and what they hold grows with the URLs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import drop_scratch, lower_ascii, scratch, sliced

ORDER = 5
#: Stands before and after a URL; in a URL itself U+FFFF is read as U+FFFE.
EDGE, OTHER = "\uffff", "\ufffe"
#: Bins of the calibration histogram over the ratio, from -4 to 4 a symbol.
BINS, REACH = 1024, 4.0
#: Models: of the first half of the decided URLs, of the second, of both; and the one that scores a decided URL of each half, or an undecided one.
HALVES, SCORED_BY = ((0,), (1,), (0, 1)), (1, 0, 2)


@dataclass(frozen=True)
class Rule:
    """``text`` is host and path; it fits the host, its subdomains, and paths that start with its path."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


RULES = (
    Rule("org/", "allow"),
    Rule("example.org/es/", "block"),
    Rule("example.org/en/1", "block"),
    Rule("com/fr/", "allow"),
    Rule("com/de/", "block"),
)


def with_parts(pages: DataFrame) -> DataFrame:
    """Add ``host`` and ``path``; both empty for a null URL or one without ``://``."""
    # "[^/?#]" and "[^?#]" take line ends too.
    host = F.regexp_extract("url", r"\A(?s:.*?)://([^/?#]*)", 1)
    path = F.regexp_extract("url", r"\A(?s:.*?)://[^/?#]*([^?#]*)", 1)
    empty = F.lit("")
    return pages.withColumn("host", F.coalesce(lower_ascii(host), empty)).withColumn("path", F.coalesce(path, empty))


def rule_of(rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits host and path, as struct<text, verdict>; null if none does."""
    best = F.lit(None).cast("struct<text: string, verdict: string>")
    for r in sorted(rules, key=lambda r: len(r.text)):
        on_host = (F.col("host") == r.host) | F.col("host").endswith("." + r.host)
        fits = on_host & F.col("path").startswith(r.path)
        best = F.when(fits, F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))).otherwise(best)
    return best


def _subject() -> Column:
    """What the models read: all after the scheme, host lower-cased; without a scheme the whole text."""
    host = r"\A(?s:.*?)://[^/?#]*"
    has = F.col("url").contains("://")
    return F.coalesce(F.when(has, F.concat("host", F.regexp_replace("url", host, ""))).otherwise(F.col("url")), F.lit(""))


def grams_of(text: str) -> list[str]:
    """The n-grams of the highest order, one for each character and the end."""
    s = EDGE * (ORDER - 1) + text.replace(EDGE, OTHER) + EDGE
    return [s[i : i + ORDER] for i in range(len(s) - ORDER + 1)]


def count_grams(decided: DataFrame) -> DataFrame:
    """(gram, n0 to n3) of the highest order; number ``2 * bad + half`` counts the URLs of that verdict and half."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 5000):
            seen: dict[int, Counter[str]] = {}
            for kind, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.setdefault(kind, Counter()).update(grams_of(text))
            for kind, own in seen.items():
                cols = [pa.array(list(own), pa.string()), pa.array([kind] * len(own), pa.int32()), pa.array(list(own.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["gram", "kind", "n"])

    rows = decided.select("kind", "subject").mapInArrow(work, "gram string, kind int, n long")
    return rows.groupBy("gram").agg(*(F.sum(F.when(F.col("kind") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(4)))


def text_grams(texts: DataFrame) -> DataFrame:
    """(key, by, gram, n) of each text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keys, bys, grams, n = [], [], [], []
            for key, by, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = Counter(grams_of(text))
                keys += [key] * len(own)
                bys += [by] * len(own)
                grams += own
                n += own.values()
            cols = [pa.array(keys, pa.binary()), pa.array(bys, pa.int32()), pa.array(grams, pa.string()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "by", "gram", "n"])

    return texts.select("key", "by", "subject").mapInArrow(work, "key binary, by int, gram string, n long")


def log_ratios(wanted: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gram, ratios), and the scratch table it reads: for each pair of models, log probability of the gram's last character if allowed less that if blocked.

    Variable order: each context's counts are mixed with the next shorter
    context's probabilities, by as much as the context has seen different
    successors (Witten-Bell); the shortest is uniform over the characters of
    all decided URLs and one for the others.
    """
    models = [(bad, m) for bad in (0, 1) for m in range(len(HALVES))]
    own = {(bad, m): sum((F.coalesce(f"n{2 * bad + h}", F.lit(0)) for h in HALVES[m]), F.lit(0)) for bad, m in models}
    lower = None
    for k in range(1, ORDER + 1):
        shorter = F.substring("gram", ORDER - k + 1, k).alias("gram")
        seen = counts.groupBy(shorter).agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(4)))
        sums = [F.sum(own[x]).alias(f"total{x[0]}{x[1]}") for x in models] + [F.count_if(own[x] > 0).alias(f"kinds{x[0]}{x[1]}") for x in models]
        contexts = seen.groupBy(F.substring("gram", 1, k - 1).alias("context")).agg(*sums)
        rows = wanted.select(shorter).distinct().withColumn("context", F.substring("gram", 1, k - 1))
        rows = rows.join(seen, "gram", "left").join(contexts, "context", "left")
        if lower is None:
            base = F.lit(1.0 / (seen.count() + 1))
            low = dict.fromkeys(models, base)
        else:
            rows = rows.join(lower.withColumnRenamed("gram", "_shorter"), F.substring("gram", 2, k - 1) == F.col("_shorter"))
            low = {x: F.col(f"p{x[0]}{x[1]}") for x in models}
        p = []
        for bad, m in models:
            total, kinds = (F.coalesce(f"{c}{bad}{m}", F.lit(0)) for c in ("total", "kinds"))
            mixed = (own[bad, m] + kinds * low[bad, m]) / (total + kinds)
            p.append(F.when(total > 0, mixed).otherwise(low[bad, m]).alias(f"p{bad}{m}"))
        lower, before = scratch(rows.select("gram", *p), "url-model"), lower
        if before is not None:
            drop_scratch(before)
    return lower.select("gram", F.array(*(F.log(f"p0{m}") - F.log(f"p1{m}") for m in range(len(HALVES)))).alias("ratios")), lower


def calibrate(scored: DataFrame) -> float:
    """The threshold with the best balanced accuracy on all decided URLs, from a histogram of fixed size."""
    bins = F.least(F.greatest(F.floor((F.col("ratio") + REACH) * (BINS / (2 * REACH))), F.lit(0)), F.lit(BINS - 1))
    rows = scored.groupBy(bins.cast("int").alias("bin"), "bad").count().collect()
    held = np.zeros((2, BINS))
    for r in rows:
        held[r["bad"], r["bin"]] = r["count"]
    totals = held.sum(axis=1)
    if totals.min() == 0:
        return float("-inf") if totals[1] == 0 else float("inf")
    below = np.concatenate([np.zeros((2, 1)), np.cumsum(held, axis=1)], axis=1) / totals[:, None]
    best = below[1] + 1 - below[0]
    at = np.flatnonzero(best >= best.max() - 1e-12)
    return float(at[len(at) // 2] * (2 * REACH / BINS) - REACH)


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and ``ratio`` of every page.

    A null URL has empty host and path, fits no rule and is judged by the models
    as the empty text. Equal URLs get equal verdicts. Without examples of one
    verdict all undecided URLs get the other (allow, if there are none at all);
    a half without examples of it leaves its model uniform. An empty table gives
    no rows; other columns are not read.
    """
    bad = (F.col("_rule.verdict") == "block").cast("int")
    parts = with_parts(pages.select("page_id", "url")).withColumn("_rule", rule_of(rules)).withColumn("subject", _subject())
    half = F.when(F.col("_rule").isNotNull(), F.pmod(F.xxhash64("subject"), F.lit(2)).cast("int")).otherwise(2)
    by = F.element_at(F.array(*map(F.lit, SCORED_BY)), half + 1)
    key = F.unhex(F.md5(F.concat(F.encode("subject", "utf-8"), F.encode(half.cast("string"), "utf-8"))))
    rows = scratch(parts.select("page_id", "host", "path", "_rule", "subject", half.alias("half"), by.alias("by"), key.alias("key")), "urls")

    counts = scratch(count_grams(rows.where("half < 2").select((2 * bad + F.col("half")).alias("kind"), "subject")), "url-counts")
    texts = rows.groupBy("key", "by").agg(F.first("subject").alias("subject"))
    pairs = scratch(text_grams(texts), "url-grams")
    ratios, held = log_ratios(pairs.select("gram").distinct(), counts)
    own = F.element_at("ratios", F.col("by") + 1)
    by_key = pairs.join(ratios, "gram").groupBy("key").agg((F.sum(own * F.col("n")) / F.sum("n")).alias("ratio"))
    scored = scratch(rows.join(by_key, "key").select("page_id", "host", "path", "_rule", "ratio"), "url-scores")
    drop_scratch(rows, counts, pairs, held)

    threshold = calibrate(scored.where("_rule is not null").withColumn("bad", bad))
    judged = F.when(F.col("ratio") >= threshold, "allow").otherwise("block")
    verdict = F.coalesce(F.col("_rule.verdict"), judged)
    return scored.select("page_id", "host", "path", F.col("_rule.text").alias("rule"), verdict.alias("verdict"), "ratio")
