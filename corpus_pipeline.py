"""A corpus pipeline of operators of chronoweave.llm, each stage working on what the one before kept.

Language ID drops documents without a language, line dedup deletes later
copies of repeated line runs, the Jaccard join leaves one document of each
group of near duplicates, decontamination drops documents that repeat
benchmark items, and mixing decides how often each of the rest is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronoweave.llm import jaccard, language, leaks, lines, mixing
from chronoweave.llm.staging import read_table, stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Also brings n_chars up to date, where documents have it."""
    out = lines.dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return leaks.remove_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, size, source_size, target, repeats, taken): how often the corpus takes each document."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", join_near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("mixing_sources", mix_sources),
]
#: The first stage's models are not expressible in SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs, name)
    return docs
