"""Registered queries of the llm operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impressa.llm import chat, decontaminate, forest, line_dedup, lm, mixing, pii, prefix_trie, secrets, simhash, token_align, token_count, toxicity
from impressa.llm.common import crc_bucket, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = crc_bucket("doc_id", 5) == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), learn_from=~held)
    out = toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.query(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.query(table(spark, sf_dir, "documents"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.query(table(spark, sf_dir, "documents"))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.query(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.query(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.query(table(spark, sf_dir, "documents"))


def op9_embedding_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.query(table(spark, sf_dir, "embeddings"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.query(table(spark, sf_dir, "conversations"))


def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.query(table(spark, sf_dir, "documents"))


def op12_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.query(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.query(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_toxicity, op2_decontaminate, op3_secrets, op4_line_dedup, op5_lm_score, op6_mix, op7_pii, op8_simhash,
    op9_embedding_forest, op10_chat_format, op11_token_align, op12_token_count, op13_prefix_trie)}

SQL: dict[str, str] = {
    "op4_line_dedup": line_dedup.SQL.format(docs="documents"),
    "op10_chat_format": chat.SQL,
    "op13_prefix_trie": prefix_trie.SQL,
}
