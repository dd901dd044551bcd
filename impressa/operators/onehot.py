"""One-hot encoding of any width (M9): a distributed dictionary, joined back.

The label of a value is its place among the values of its column, most frequent
first, then by the value.  Counting, ordering (W1) and joining are all
distributed, so no label comes to the driver and a column may have more
labels than fit there; only one number a column, its width, does.

Null values and values that the dictionary does not hold take a column's last
place.  A row's positions are ascending, one a column.  An empty table gives
an empty dictionary and columns of one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impressa.operators.ordering import global_index
from impressa.sources.sinks import stage


def _long(df: DataFrame, columns: list[str], *keep) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(i).alias("col"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)])
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.col", "_p.value")


def dictionary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col, value, n, label): label 0 is the most frequent value of column number ``col``; ties by value."""
    counts = stage(_long(df, columns).where("value IS NOT NULL").groupBy("col", "value").agg(F.count(F.lit(1)).alias("n")), "onehot-counts")
    placed = stage(global_index(counts.withColumn("_less", -F.col("n")), ["col", "_less", "value"], "_at").drop("_less"), "onehot-labels")
    first = placed.groupBy("col").agg(F.min("_at").alias("_first"))
    return placed.join(first, "col").select("col", "value", "n", (F.col("_at") - F.col("_first")).alias("label"))


def widths(labels: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n_labels, category_size): labels learned and places taken by each column."""
    spark = labels.sparkSession
    names = spark.createDataFrame(list(enumerate(columns)), "col int, feature string")
    n = labels.groupBy("col").agg(F.count(F.lit(1)).alias("n"))
    return names.join(n, "col", "left").select("feature", F.coalesce("n", F.lit(0)).cast("int").alias("n_labels"),
                                               (F.coalesce("n", F.lit(0)) + 1).cast("int").alias("category_size"))


def encode(df: DataFrame, labels: DataFrame, columns: list[str], key: str, out: str = "positions") -> DataFrame:
    """(``key``, ``out``): the places that are 1 in each row's one-hot vector over all columns; ``key`` is unique.

    Values meet their labels in one join, whose dictionary side holds each
    value once, so AQE can split a value that many rows share.
    """
    size = {r["col"]: r["n"] for r in labels.groupBy("col").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, at = [], 0
    for i in range(len(columns)):
        offsets.append((i, at, size.get(i, 0)))
        at += size.get(i, 0) + 1
    places = df.sparkSession.createDataFrame(offsets, "col int, _offset long, _size long")
    met = _long(df, columns, key).join(labels.select("col", "value", "label"), ["col", "value"], "left").join(places, "col")
    place = F.col("_offset") + F.coalesce("label", "_size")
    return met.select(key, place.alias("_place")).groupBy(key).agg(F.sort_array(F.collect_list("_place")).alias(out))
