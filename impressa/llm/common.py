"""Small helpers shared by the llm operators.

Words everywhere are maximal runs of non-whitespace, where whitespace is
``\\x20`` and ``\\x09-\\x0D``, and case folding touches A-Z only.  On UTF-8
bytes these are exactly ``bytes.lower().split()``.
"""

from __future__ import annotations

import binascii

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: bytes) -> list[bytes]:
    return text.lower().split()


def crc_bucket(doc_id, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``; null ids count as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % m).cast("int")


def py_crc_bucket(doc_id, m: int) -> int:
    return binascii.crc32(b"" if doc_id is None else str(doc_id).encode()) % m


def text_bytes(col: str = "text") -> Column:
    """Text as bytes, so that Python tasks need no decoding; null counts as empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def doc_key(text: str = "text", doc_id: str = "doc_id") -> list[Column]:
    """Join key of a document row without a unique id: (id, is-null flag, text hash).

    Rows that agree on id and text are the same document repeated.
    """
    return [F.coalesce(F.col(doc_id), F.lit(0)).cast("long").alias("__llm_id"),
            F.col(doc_id).isNull().alias("__llm_null"),
            F.xxhash64(F.col(text)).alias("__llm_text")]


KEY = ["__llm_id", "__llm_null", "__llm_text"]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def run_labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest index reachable over undirected edges (u, v) among 0..n-1."""
    lab = np.arange(n)
    while len(u):
        m = np.minimum(lab[u], lab[v])
        new = lab.copy()
        np.minimum.at(new, u, m)
        np.minimum.at(new, v, m)
        new = new[new]
        if np.array_equal(new, lab):
            break
        lab = new
    return lab
