"""The corpus pipeline: five stages over documents, each on all that its predecessor kept.

Toxic documents go, repeated line windows are cut out, of near duplicates one stays,
documents with benchmark passages go, and the rest is mixed to the sources' weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stepchange.llm import decontaminate, line_dedup, mixing, near_dup, toxicity
from stepchange.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 1. Trained on the labelled rows among `docs`."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 2. Texts lose later windows; no document goes."""
    return line_dedup.dedup_lines(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 6. The smallest doc_id of each group stays."""
    return near_dup.deduplicated(docs)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 7."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 5. One row for each taken copy of a document."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dup", dedup_near),
    ("decontaminate", drop_leaked),
    ("mix", mix_sources),
]

#: A trained model can't be put in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
