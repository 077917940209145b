"""The ten operators and the pipeline as registered queries, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from brindle.llm import decontam, kneserney, packing, quality, sharding, simhash, spans, sql, suffix, toxicity, urls
from brindle.llm.common import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.with_digests(suffix.remove_repeats(table(spark, sf_dir, "documents")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))
    return packing.with_digests(packed)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.judge(table(spark, sf_dir, "documents")).select(*columns)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return decontam.with_digests(found)


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneserney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.remove_repeated_spans(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_suffix_dedup, op2_simhash, op3_url_filter, op4_packing, op5_quality_rules,
        op6_decontamination, op7_kneser_ney, op8_sentence_spans, op9_sharding, op10_toxicity,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """The operators that SQL can express; the others are tested against brute force."""
    return {
        "op1_suffix_dedup": sql.SUFFIX_DEDUP,
        "op5_quality_rules": sql.QUALITY_RULES,
        "op6_decontamination": sql.DECONTAMINATION,
        "op8_sentence_spans": sql.SENTENCE_SPANS,
    }
