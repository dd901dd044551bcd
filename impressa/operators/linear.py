"""Linear models over hashed binary features in SQL form (M3, M5 bayes).

Rows carry an ``ARRAY<INT>`` of hashed indices.  Training the Bernoulli naive
Bayes model is one grouped aggregate per index (partial aggregation before the
shuffle, so a very common index costs one row per task).  Scoring is a narrow
map: the weights of a bounded hash space are one array, a scalar of the query,
and each row adds up its entries.

Weights are fixed point (``round(w * SCALE)`` as BIGINT): sums of integers do
not depend on the order of addition, so scores are bit-identical across runs,
partitionings and engines, and ties in the score stay ties.

The array has exactly ``m`` entries (the hash-space size, a parameter); above
``DENSE_MAX`` of them rows are exploded and joined with the weight table
instead, shuffled on ``idx`` with AQE splitting skewed partitions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impressa.sources.sinks import stage

SCALE = 1_000_000_000
DENSE_MAX = 1 << 22  # entries of the weight array, 32 MB


@dataclass
class LinearModel:
    """Fixed-point linear model: score = intercept + sum(w[idx]) over present idx."""

    weights: DataFrame          # (idx INT, w BIGINT)
    intercept: int              # BIGINT, fixed point
    default_weight: int         # weight of an index absent from ``weights``
    m: int                      # hash-space size (bound on len(weights))
    scale: int = SCALE


def _q(x: float, scale: int = SCALE) -> int:
    """Round half away from zero, as SQL ``round`` does."""
    y = x * scale
    return int(math.floor(abs(y) + 0.5)) * (1 if y >= 0 else -1)


def fit_bernoulli_bayes(rows: DataFrame, m: int, label: str = "label", indices: str = "indices",
                        alpha: float = 1.0, scale: int = SCALE) -> LinearModel:
    """M5 (bayes): Bernoulli naive Bayes on binary hashed features, in SQL form.

    theta[j,y] = (n[j,y] + alpha) / (N[y] + 2 alpha); prior (N[y] + alpha) / (N + 2 alpha),
    the smoothing of Spark ML's ``NaiveBayes(modelType="bernoulli")``.  The
    log-odds equal ``intercept + sum over present j of w[j]`` with
    w[j] = logit(theta[j,1]) - logit(theta[j,0]) and an intercept that folds in
    the absent-feature terms of all m indices.

    The weight table (at most m rows) is staged: it is read by the intercept
    aggregate and by every scoring job.
    """
    y = F.col(label).cast("bigint")
    tot = rows.agg(F.sum(y).alias("n1"), F.count(F.lit(1)).alias("n")).first()
    n1 = int(tot["n1"] or 0)
    n0 = int(tot["n"]) - n1
    d1, d0 = math.log(n1 + 2 * alpha), math.log(n0 + 2 * alpha)

    counts = (rows.select(y.alias("y"), F.explode(indices).alias("idx"))
                  .groupBy("idx")
                  .agg(F.sum("y").alias("c1"), F.sum(1 - F.col("y")).alias("c0")))
    # log theta and log (1 - theta) per class, then fixed-point weights
    lt1 = F.log(F.col("c1") + alpha) - F.lit(d1)
    lt0 = F.log(F.col("c0") + alpha) - F.lit(d0)
    ln1 = F.log(F.lit(n1 + 2 * alpha) - F.col("c1") - alpha) - F.lit(d1)
    ln0 = F.log(F.lit(n0 + 2 * alpha) - F.col("c0") - alpha) - F.lit(d0)
    weights = stage(counts.select(
        F.col("idx").cast("int").alias("idx"),
        F.round((lt1 - ln1 - lt0 + ln0) * scale).cast("bigint").alias("w"),
        F.round((ln1 - ln0) * scale).cast("bigint").alias("absent"),
    ), "bayes-weights")
    seen = weights.agg(F.count(F.lit(1)).alias("k"), F.sum("absent").alias("s")).first()
    k_seen, absent_seen = int(seen["k"]), int(seen["s"] or 0)

    # an index never seen in training: theta = alpha / (N[y] + 2 alpha)
    u1 = math.log(alpha) - d1
    u0 = math.log(alpha) - d0
    v1 = math.log(n1 + alpha) - d1
    v0 = math.log(n0 + alpha) - d0
    default_w = _q((u1 - v1) - (u0 - v0), scale)
    absent_unseen = _q((m - k_seen) * (v1 - v0), scale)
    prior = _q(math.log(n1 + alpha) - math.log(n0 + alpha), scale)
    return LinearModel(weights.select("idx", "w"), prior + absent_seen + absent_unseen,
                       default_w, m, scale)


def _dense(model: LinearModel):
    """All ``m`` weights in index order, as a scalar of the query."""
    spark = model.weights.sparkSession
    every = spark.range(model.m).select(F.col("id").cast("int").alias("idx"))
    entry = F.struct("idx", F.coalesce("w", F.lit(model.default_weight)).alias("w"))
    return (every.join(model.weights, "idx", "left").agg(F.sort_array(F.collect_list(entry)).alias("a"))
            .select(F.col("a.w").alias("a")).scalar())


def linear_scores(rows: DataFrame, model: LinearModel, key: str = "row_id",
                  indices: str = "indices", keep: tuple = ("label",), dense_max: int = DENSE_MAX) -> DataFrame:
    """M3 (SQL form): (key, *keep, score BIGINT, p DOUBLE) per row.

    Rows without features keep their intercept-only score.
    """
    if model.m <= dense_max:
        ids = F.coalesce(F.col(indices), F.array().cast("array<int>"))
        out = rows.withColumns({"_w": _dense(model), "_ids": ids})
        s = F.aggregate("_ids", F.lit(0).cast("bigint"), lambda a, i: a + F.get(F.col("_w"), i))
        out = out.select(key, *keep, (F.lit(model.intercept) + s).cast("bigint").alias("score"))
        return out.withColumn("p", sigmoid_fixed(F.col("score"), model.scale))
    w = model.weights
    exploded = rows.select(key, *keep, F.explode_outer(indices).alias("idx"))
    joined = exploded.join(w, "idx", "left")
    term = F.when(F.col("idx").isNull(), F.lit(0)).otherwise(
        F.coalesce(F.col("w"), F.lit(model.default_weight)))
    scored = joined.groupBy(key, *keep).agg(F.sum(term).alias("s"))
    score = (F.lit(model.intercept) + F.col("s")).cast("bigint")
    return scored.select(key, *keep, score.alias("score")).withColumn(
        "p", sigmoid_fixed(F.col("score"), model.scale))


def sigmoid_fixed(score, scale: int = SCALE):
    return 1.0 / (1.0 + F.exp(-(score.cast("double") / F.lit(float(scale)))))
