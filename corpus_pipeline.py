"""A corpus pipeline of five llm operators, each on all that its predecessor kept.

Every stage is written as Parquet under ``spark.checkpoint.dir`` and read
again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from impressa.llm import decontaminate, line_dedup, mixing, simhash, toxicity
from impressa.llm.common import table
from impressa.sources.sinks import stage


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate lines; those that held nothing else go."""
    return line_dedup.clean(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every SimHash near-duplicate group."""
    return simhash.keep_first(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the mix, with size, source_size, target and taken (words, repeats counted)."""
    return mixing.mix_by_source(docs).where("taken > 0")


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_near),
    ("benchmark_decontamination", remove_benchmark),
    ("mix_to_weights", mix_sources),
]

#: The toxicity model, SimHash and the flow have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
