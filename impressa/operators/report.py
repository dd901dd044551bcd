"""Report operators over long metric tables.

Input: any long table (engine, train_size, metric columns).  Every operator is
a grouped aggregate, a partitioned window or an equi-join on the size, so it
runs distributed on tables of any length (e.g. per-day x per-feature click
rates at scale), not only on a few dozen result rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pivot_metric(df: DataFrame, metric: str, x: str = "train_size", series: str = "engine",
                 series_values: list[str] | None = None) -> DataFrame:
    """V1: long -> wide, one column per series, one row per x.

    Pass ``series_values`` to skip the distinct-values job (A3) and to fix the
    column order.
    """
    g = df.groupBy(x)
    p = g.pivot(series, series_values) if series_values is not None else g.pivot(series)
    return p.agg(F.first(metric)).orderBy(x)


def outer_merge(df: DataFrame, metric: str, x: str = "train_size", series: str = "engine",
                series_values: list[str] | None = None) -> DataFrame:
    """One column per series, matched on x, sizes of any series kept: one grouped aggregate."""
    if series_values is None:
        series_values = sorted(r[0] for r in df.select(series).distinct().collect())
    cols = [F.max(F.when(F.col(series) == s, F.col(metric))).alias(s) for s in series_values]
    return df.where(F.col(series).isin(series_values)).groupBy(x).agg(*cols)


def best_per_size(df: DataFrame, metric: str, lower_is_better: bool = True,
                  x: str = "train_size", series: str = "engine") -> DataFrame:
    """V2: the best series per x (ties broken by series name)."""
    order = F.col(metric).asc() if lower_is_better else F.col(metric).desc()
    w = Window.partitionBy(x).orderBy(order, F.col(series))
    return (df.filter(F.col(metric).isNotNull())
              .withColumn("_rank", F.row_number().over(w))
              .filter("_rank = 1").drop("_rank"))


def best_overall(df: DataFrame, metric: str, lower_is_better: bool = True,
                 series: str = "engine") -> DataFrame:
    """V2: single best row over the whole table (TakeOrdered, one row)."""
    order = F.col(metric).asc() if lower_is_better else F.col(metric).desc()
    return df.filter(F.col(metric).isNotNull()).orderBy(order, F.col(series), "train_size").limit(1)


def ratio_between(df: DataFrame, a: str, b: str, metric: str, x: str = "train_size",
                  series: str = "engine") -> DataFrame:
    """V3: metric(a) / metric(b) at equal x, and the first x from which a < b.

    The threshold x is one aggregate value read back as a literal.
    """
    left = df.filter(F.col(series) == a).select(x, F.col(metric).alias("a_value"))
    right = df.filter(F.col(series) == b).select(x, F.col(metric).alias("b_value"))
    j = left.join(right, x, "inner")
    first = j.agg(F.min(F.when(F.col("a_value") < F.col("b_value"), F.col(x)))).first()[0]
    return j.select(x, "a_value", "b_value",
                    F.try_divide("a_value", "b_value").alias("ratio"),
                    F.lit(first).cast(df.schema[x].dataType).alias("a_better_from"))


def combine_common(tables: list[DataFrame]) -> DataFrame:
    """V4: union of result tables on the columns they all share."""
    common = [c for c in tables[0].columns if all(c in t.columns for t in tables[1:])]
    return reduce(lambda a, b: a.unionByName(b), [t.select(*common) for t in tables])
