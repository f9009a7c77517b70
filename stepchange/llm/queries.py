"""The registered queries of the corpus operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stepchange.llm import chat, decontaminate, language, line_dedup, mixing, near_dup, periodic_runs, pieces, quality_rules, secrets, suffix_dedup, toxicity, variants
from stepchange.llm.common import table

#: The public tokenizer that op 12 encodes with; its place on this machine is a parameter of the operator.
TOKENIZER = "piece_bpe_32k.model"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(table(spark, sf_dir, "conversations"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.report(table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.report(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.report(table(spark, sf_dir, "documents"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.report(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.report(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_line_dedup,
        op3_chat_format,
        op4_language_id,
        op5_mix_sources,
        op6_near_dup,
        op7_decontaminate,
        op8_suffix_dedup,
        op9_secret_scan,
        op10_quality_rules,
        op11_periodic_runs,
        op12_sentencepiece,
        op13_spelling_variants,
    )
}
#: The others are held against brute force, round trips or held-out accuracy in the tests.
ORACLES = {
    "op2_line_dedup": line_dedup.ORACLE_SQL,
    "op3_chat_format": chat.ORACLE_SQL,
    "op5_mix_sources": mixing.ORACLE_SQL,
    "op6_near_dup": near_dup.ORACLE_SQL,
    "op7_decontaminate": decontaminate.ORACLE_SQL,
}
