"""Quality rules whose thresholds come from the data (DataFrame operations only).

Per document, counts are made inside the row with higher-order functions: no
row is exploded and nothing is shuffled. The counts of one pass are written
once; mergeable quantile summaries per (language, source), and per language for
groups too small to judge, give the fences; the fences join back on the group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import SPACES, ddl_name, scratch

#: Characters that count as symbols: fixed values.
SYMBOLS = "#*$%&|<>"
GAP = r"[\x20\x09-\x0D]+"
INK = r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class Fence:
    """A metric rejects what lies more than ``spreads`` quartile distances, and
    at least ``floor``, outside its group's quartiles."""

    metric: str
    floor: float
    low: bool = False
    spreads: float = 3.0


FENCES = (
    Fence("symbol_ratio", 0.08),
    Fence("dup_line_ratio", 0.25),
    Fence("repeat_ratio", 0.25),
    Fence("word_length", 3.0),
    Fence("word_length", 2.5, low=True),
)


def with_counts(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Three-word windows are compared by XXH64 within one text; sorting them puts
    equal ones side by side, and each repeated window adds the words that the
    window before it has not covered yet: linear memory, n log n time.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return (
        docs.withColumn("_text", text)
        .withColumn("_words", F.array_remove(F.split("_text", GAP), ""))
        .withColumn("_lines", F.filter(F.split("_text", "\n"), lambda line: line.rlike(INK)))
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.translate("_text", SPACES, "")).cast("long"))
        .withColumn("n_symbols", (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long"))
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
        .withColumn("_windows", _sorted_windows("_hashes"))
        .withColumn("_starts", _repeated_starts("_windows"))
        .withColumn("n_repeat_words", _covered("_starts").cast("long"))
        .drop("_text", "_words", "_lines", "_hashes", "_windows", "_starts")
    )


def _sorted_windows(hashes: str) -> Column:
    h = F.col(hashes)
    window = lambda _, i: F.struct(
        F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)).alias("w"), i.alias("i")
    )
    return F.array_sort(F.transform(F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))), window))


def _repeated_starts(windows: str) -> Column:
    w = F.col(windows)
    same = lambda x, j: F.coalesce(x["w"] == F.get(w, j)["w"], F.lit(False))
    twice = F.filter(w, lambda x, i: same(x, i + 1) | ((i > 0) & same(x, F.greatest(i - 1, F.lit(0)))))
    return F.array_sort(F.transform(twice, lambda x: x["i"]))


def _covered(starts: str) -> Column:
    fold = F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(i.alias("at"), (acc["n"] + F.least(i - acc["at"], F.lit(3))).alias("n")),
    )
    return fold["n"]


def with_ratios(counts: DataFrame) -> DataFrame:
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return (
        counts.withColumn("symbol_ratio", per("n_symbols", "word_chars"))
        .withColumn("dup_line_ratio", per("n_dup_lines", "n_lines"))
        .withColumn("repeat_ratio", per("n_repeat_words", "n_words"))
        .withColumn("word_length", per("word_chars", "n_words"))
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    )


def fences_of(ratios: DataFrame, keys: list[str], accuracy: int = 2000) -> DataFrame:
    """Quartiles of each metric by group, from summaries that merge on both sides of the shuffle.

    Only documents that pass the base rules shape them. A task sends one summary
    a group, so a group with a third of all rows costs no more than another.
    """
    metrics = sorted({f.metric for f in FENCES})
    sketches = [F.percentile_approx(m, [0.25, 0.75], accuracy).alias(f"_q_{m}") for m in metrics]
    table = ratios.where(~F.col("base_failed")).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *sketches)
    return table.withColumn("_q", F.struct(*[F.col(f"_q_{m}").alias(m) for m in metrics])).drop(*[f"_q_{m}" for m in metrics])


def judge(docs: DataFrame, min_group: int = 100) -> DataFrame:
    """The counts of every document, ``base_failed`` and ``kept``, with its columns but the text.

    Groups of under ``min_group`` judged documents take their language's fences.
    Null language or source is a group like any other; null text has no words
    and fails; an empty table gives no rows; repeated rows are judged alike; a
    group without judged documents rejects by the base rules alone. Columns
    named like a count are replaced.
    """
    own = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    rest = docs.drop(*own, "kept", "base_failed")
    return _verdicts(scratch(with_ratios(with_counts(rest)).drop("text"), "quality"), min_group)


def _verdicts(ratios: DataFrame, min_group: int) -> DataFrame:
    fine = fences_of(ratios, ["lang", "source"]).select(
        F.col("lang").alias("_l"), F.col("source").alias("_s"), F.col("_n").alias("_fine_n"), F.col("_q").alias("_fine")
    )
    coarse = fences_of(ratios, ["lang"]).select(F.col("lang").alias("_cl"), F.col("_q").alias("_coarse"))
    # Written first, so that Spark knows their sizes before it chooses whether the documents must be shuffled to them.
    fine, coarse = scratch(fine, "fences"), scratch(coarse, "fences")
    joined = ratios.join(
        fine, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left"
    ).join(coarse, F.col("lang").eqNullSafe(F.col("_cl")), "left")
    quartiles = F.when(F.col("_fine_n") >= min_group, F.col("_fine")).otherwise(F.col("_coarse"))
    joined = joined.withColumn("_q", quartiles)
    outside = F.lit(False)
    for fence in FENCES:
        value, low, high = F.col(fence.metric), F.col("_q")[fence.metric][0], F.col("_q")[fence.metric][1]
        margin = F.greatest((high - low) * fence.spreads, F.lit(fence.floor))
        outside = outside | (value < low - margin if fence.low else value > high + margin)
    kept = ~F.col("base_failed") & ~F.coalesce(outside, F.lit(False))
    return joined.withColumn("kept", kept).drop("_l", "_s", "_cl", "_fine_n", "_fine", "_coarse", "_q")


def filter_documents(docs: DataFrame, min_group: int = 100) -> DataFrame:
    """The documents that ``judge`` keeps, with the columns of ``docs``.

    Each document lies in one struct beside its counts in the table that is
    written once, so its verdict needs no join back and no name can clash.
    """
    whole = F.struct(*[F.col(ddl_name(c)) for c in docs.columns]).alias("_doc")
    ratios = with_ratios(with_counts(docs.select(whole, "text", "lang", "source"))).drop("text")
    return _verdicts(scratch(ratios, "quality-docs"), min_group).where("kept").select("_doc.*")
