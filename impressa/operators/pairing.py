"""Pair two line-aligned datasets (labels, scores) by a carried row key.

In a distributed setting there is no line order, so the row key travels with
the rows and the pairing is an equi-join.  Both sides must hold every key
exactly once; a key that is missing, extra or repeated on a side fails the job
that reads the result.  The check is part of the same plan: one full outer
join of the sides grouped by key (null is a key).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNALIGNED = "unaligned inputs"


def _once(df: DataFrame, key: str, side: str) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.groupBy(F.col(key).alias(f"{side}_key")).agg(F.first(F.struct(*rest)).alias(f"{side}_row"), F.count(F.lit(1)).alias(f"{side}_n"))


def pair_by_key(left: DataFrame, right: DataFrame, key: str, check: bool = True) -> DataFrame:
    """(key, columns of left, columns of right); with ``check``, reading it raises unless the keys match 1:1."""
    if not check:
        return left.join(right, key, "inner")
    a, b = _once(left, key, "l"), _once(right, key, "r")
    j = a.join(b, F.col("l_key").eqNullSafe(F.col("r_key")), "full_outer")
    ok = F.coalesce((F.col("l_n") == 1) & (F.col("r_n") == 1), F.lit(False))
    told = F.concat(F.lit(UNALIGNED + ": key "), F.coalesce(F.coalesce("l_key", "r_key").cast("string"), F.lit("null")))
    checked = j.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(told).cast("boolean")))
    return checked.select(F.col("l_key").alias(key), "l_row.*", "r_row.*")
