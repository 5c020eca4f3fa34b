"""Queries over the driver's tables, one an operator of this package, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from overlapse.llm.html_text import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from overlapse.llm.katz import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"), modulus=7, remainder=2)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from overlapse.llm.line_dedup import line_verdicts

    return line_verdicts(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from overlapse.llm.quality_rules import quality_verdicts

    return quality_verdicts(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    from overlapse.llm.packing import pack_documents

    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from overlapse.llm.simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"), width=4, distance=4)


def op7_token_counts(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    from overlapse.llm.token_counts import token_counts

    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path, limit=1024)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from overlapse.llm.mixing import mix_schedule

    return mix_schedule(table(spark, sf_dir, "documents"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from overlapse.llm.exact_topk import exact_topk

    return exact_topk(table(spark, sf_dir, "embeddings"), k=20, scale=64.0, every=20)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from overlapse.llm.quality_model import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    """Queries without an entry can't be stated in SQL with equal values; tests hold them against brute force."""
    import math

    from overlapse.llm import oracles, quality_rules

    return {
        "op3_line_dedup": oracles.LINE_DEDUP,
        "op4_quality_rules": oracles.quality_rules(quality_rules.METRICS, math.log(quality_rules.GAMMA), quality_rules.MIN_ROWS, quality_rules.TRIM, quality_rules.EDGE, quality_rules.SLACK),
        "op8_mixing": oracles.MIXING,
        "op9_exact_topk": oracles.EXACT_TOPK,
    }
