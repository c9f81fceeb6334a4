"""The corpus pipeline: language ID, near duplicates, repeated passages, benchmark text, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontamination, jaccard_join, language_id, pattern_packing, substring_dedup
from tessera.llm._store import discard, freeze, fresh_path, scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter or a recognisable language; learns from the stage's own labelled rows outside the held-out fold."""
    return language_id.keep_known(docs, language_id.train(docs.where(~language_id.held_out("doc_id"))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of each near-duplicate group."""
    return jaccard_join.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 13 words or more that a document of a smaller id has too."""
    return substring_dedup.dedup_substrings(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of the benchmark."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2,048 tokens: a row per piece."""
    return pattern_packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", cut_benchmark),
    ("packing", pack),
]

#: SQL can't express the network, nor the packing plan: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        # What a stage has frozen for itself goes with it, and its input too.
        with scratch(spark):
            kept = freeze(stage(spark, docs, sf_dir), name, path)
        if hasattr(docs, "frozen"):
            discard(spark, docs.frozen)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
