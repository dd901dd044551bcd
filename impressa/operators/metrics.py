"""Exact binary-classification metrics as distributed aggregates.

Scores never reach the driver: a grouped aggregate per distinct score, a
distributed prefix sum (W2) and a final aggregate yield the ROC curve, the
exact AUC (ties count one half) and log loss.  Counts are summed as
DECIMAL(38,0), so the AUC numerator is exact; only the final division is
floating point.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impressa.operators.ordering import prefix_sums
from impressa.schema import LOGLOSS_EPS
from impressa.sources.sinks import stage

D38 = "decimal(38,0)"


def clipped(p, eps: float = LOGLOSS_EPS):
    p = F.col(p) if isinstance(p, str) else p
    return F.least(F.greatest(p.cast("double"), F.lit(eps)), F.lit(1.0 - eps))


def log_loss_of(label, p, eps: float = LOGLOSS_EPS):
    """A4 per-row term of two columns: -ln(p) for positives, -ln(1-p) for negatives (p clipped); null where either is."""
    q = clipped(p, eps)
    return F.when(p.isNotNull(), -F.when(label == 1, F.log(q)).when(label == 0, F.log(1.0 - q)))


def log_loss_expr(label: str = "label", p: str = "p", eps: float = LOGLOSS_EPS):
    """A4 per-row term by column names."""
    return log_loss_of(F.col(label), F.col(p), eps)


def log_loss(df: DataFrame, label: str = "label", p: str = "p", eps: float = LOGLOSS_EPS) -> DataFrame:
    """A4: one row ``log_loss`` (mean over the rows with a label and a score)."""
    return df.agg(F.avg(log_loss_expr(label, p, eps)).alias("log_loss"))


def score_histogram(df: DataFrame, label: str = "label", score: str = "p") -> DataFrame:
    """Rows per distinct score: (score, pos, neg).  Map-side partial aggregation
    keeps a score shared by many rows to one row per task before the shuffle.
    Rows without a label or a score count nowhere."""
    y = F.col(label).cast("bigint")
    return (df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("score"))
              .agg(F.sum(y).cast("bigint").alias("pos"),
                   F.sum(1 - y).cast("bigint").alias("neg")))


def roc_curve(df: DataFrame, label: str = "label", score: str = "p",
              buckets: int | None = None) -> DataFrame:
    """A5: (threshold, tp, fp, tpr, fpr), one row per distinct score.

    Cumulative counts run from the highest score down; the (0,0) start point is
    the threshold +inf row.  Class totals are one aggregate row read back as
    two literals.
    """
    hist = stage(score_histogram(df, label, score), "roc-hist").withColumn("neg_score", -F.col("score"))
    tot = hist.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    P, N = int(tot["P"] or 0), int(tot["N"] or 0)
    cum = prefix_sums(hist, ["neg_score"], {"tp": F.col("pos"), "fp": F.col("neg")},
                      inclusive=True, ranges=buckets)
    spark = df.sparkSession
    start = spark.createDataFrame([(float("inf"), 0, 0)], "threshold double, tp bigint, fp bigint")
    body = cum.select(F.col("score").alias("threshold"), "tp", "fp")
    return start.unionByName(body).select(
        "threshold", "tp", "fp",
        F.try_divide(F.col("tp").cast("double"), F.lit(float(P))).alias("tpr"),
        F.try_divide(F.col("fp").cast("double"), F.lit(float(N))).alias("fpr"))


def roc_buckets(df: DataFrame, label: str = "label", score: str = "p", points: int = 1000, accuracy: int = 100_000) -> DataFrame:
    """Rows per bucket of scores: (bucket, low, high, pos, neg), under 2 x ``points`` rows, staged.

    Buckets are cut before and behind ``points`` - 1 approximate quantiles of
    all scores, from sketches that merge by aggregation.  So a score that many
    rows share has a bucket of its own, and any other bucket holds about
    1 / ``points`` of the rows at most; counts are exact.  Rows without a label
    or a score count nowhere.
    """
    from pyspark.ml.feature import Bucketizer

    own = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select(F.col(label).cast("bigint").alias("y"), F.col(score).cast("double").alias("s"))
    cuts = own.agg(F.percentile_approx("s", [k / points for k in range(1, points)], accuracy)).first()[0]
    inf = float("inf")
    splits = [-inf, *sorted({x for c in cuts or [0.0] for x in (float(c), math.nextafter(float(c), inf))}), inf]
    placed = Bucketizer(splits=splits, inputCol="s", outputCol="bucket", handleInvalid="keep").transform(own)
    return stage(placed.groupBy(F.col("bucket").cast("int").alias("bucket")).agg(
        F.min("s").alias("low"), F.max("s").alias("high"), F.sum("y").cast("bigint").alias("pos"), F.sum(1 - F.col("y")).cast("bigint").alias("neg")), "roc-buckets")


def roc_sketch(df: DataFrame, label: str = "label", score: str = "p", points: int = 1000, accuracy: int = 100_000) -> DataFrame:
    """A5 with a bounded number of points: (threshold, tp, fp, tpr, fpr) from +inf down, at most 2 x ``points`` rows.

    Every point lies on the exact curve of ``roc_curve``; only points between
    are left out.
    """
    b = roc_buckets(df, label, score, points, accuracy)
    tot = b.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    P, N = int(tot["P"] or 0), int(tot["N"] or 0)
    cum = prefix_sums(b.withColumn("_down", -F.col("bucket")), ["_down"], {"tp": F.col("pos"), "fp": F.col("neg")}, inclusive=True)
    start = df.sparkSession.createDataFrame([(float("inf"), 0, 0)], "threshold double, tp bigint, fp bigint")
    return start.unionByName(cum.select(F.col("low").alias("threshold"), "tp", "fp")).select(
        "threshold", "tp", "fp", F.try_divide(F.col("tp").cast("double"), F.lit(float(P))).alias("tpr"),
        F.try_divide(F.col("fp").cast("double"), F.lit(float(N))).alias("fpr"))


def auc_bounds(df: DataFrame, label: str = "label", score: str = "p", points: int = 1000, accuracy: int = 100_000) -> DataFrame:
    """One row (auc_low, auc_high) that the exact AUC (A6) lies between, from ``roc_buckets``.

    Pairs of different buckets are in known order and pairs of one score are
    ties; only pairs inside a bucket of several scores are open, at most about
    1 / ``points`` of all.
    """
    below = prefix_sums(roc_buckets(df, label, score, points, accuracy), ["bucket"], {"neg_below": F.col("neg")}, inclusive=False)
    pos, neg, nb = (F.col(c).cast(D38) for c in ("pos", "neg", "neg_below"))
    tied = F.col("low") == F.col("high")
    sums = below.agg(F.sum(2 * pos * nb + F.when(tied, pos * neg).otherwise(F.lit(0).cast(D38))).alias("sure"),
                     F.sum(F.when(~tied, 2 * pos * neg).otherwise(F.lit(0).cast(D38))).alias("open"), F.sum(pos).alias("P"), F.sum(neg).alias("N"))
    whole = (2 * F.col("P") * F.col("N")).cast("double")
    return sums.select(F.try_divide(F.col("sure").cast("double"), whole).alias("auc_low"),
                       F.try_divide((F.col("sure") + F.col("open")).cast("double"), whole).alias("auc_high"))


def metrics_from_histogram(hist: DataFrame, eps: float = LOGLOSS_EPS,
                           buckets: int | None = None) -> DataFrame:
    """A6 + A4 on a (score, pos, neg) histogram of probabilities.

    One row (n, positives, roc_auc, log_loss).  AUC counts pairs exactly:
    sum over scores of pos*(2*neg_below + neg) / (2*P*N).
    """
    below = prefix_sums(hist, ["score"], {"neg_below": F.col("neg")},
                        inclusive=False, ranges=buckets)
    pos, neg, nb = (F.col(c).cast(D38) for c in ("pos", "neg", "neg_below"))
    q = clipped("score", eps)
    ll = F.col("pos") * -F.log(q) + F.col("neg") * -F.log(1.0 - q)
    agg = below.agg(
        F.sum(2 * pos * nb + pos * neg).alias("num"),
        F.sum(pos).alias("P"), F.sum(neg).alias("N"), F.sum(ll).alias("ll"))
    return agg.select(
        (F.col("P") + F.col("N")).cast("bigint").alias("n"),
        F.col("P").cast("bigint").alias("positives"),
        F.try_divide(F.col("num").cast("double"),
                     (2 * F.col("P") * F.col("N")).cast("double")).alias("roc_auc"),
        F.try_divide(F.col("ll"), (F.col("P") + F.col("N")).cast("double")).alias("log_loss"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "p",
            buckets: int | None = None) -> DataFrame:
    """Exact ROC AUC (trapezoid rule over all distinct thresholds; ties = 1/2).

    Null when only one class is present.
    """
    return binary_metrics(df, label, score, buckets=buckets).select("roc_auc")


def binary_metrics(df: DataFrame, label: str = "label", p: str = "p",
                   eps: float = LOGLOSS_EPS, buckets: int | None = None) -> DataFrame:
    """A8 (without the curve): one row (n, positives, roc_auc, log_loss).

    The scored input is aggregated once into a per-score histogram (at most
    one row per distinct score), which is staged so the prefix-sum passes
    read it instead of re-running the scoring.
    """
    return metrics_from_histogram(stage(score_histogram(df, label, p), "score-hist"), eps, buckets)


def by_part(parts: dict[str, DataFrame], measure) -> DataFrame:
    """``measure`` (``binary_metrics``, ``roc_curve``) of each named part, with the name in ``part``."""
    out = [measure(df).select(F.lit(name).alias("part"), "*") for name, df in parts.items()]
    return reduce(DataFrame.unionByName, out)


def many_metrics(scored: DataFrame, probabilities: dict[str, Column], label: str = "label") -> DataFrame:
    """A8 for many scores of the same rows: ``binary_metrics`` of each entry of ``probabilities``, its name in ``part``.

    One scan of the rows makes the histograms of all scores, and one order of
    (part, score) their running counts.
    """
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("part"), p.cast("double").alias("score")) for name, p in probabilities.items()]))
    y = F.col(label).cast("bigint")
    long = scored.where(F.col(label).isNotNull()).select(y.alias("y"), each.alias("e")).select("y", "e.*").where("score IS NOT NULL")
    hist = stage(long.groupBy("part", "score").agg(F.sum("y").cast("bigint").alias("pos"), F.sum(1 - F.col("y")).cast("bigint").alias("neg")), "score-hists")
    below = prefix_sums(hist, ["part", "score"], {"neg_below": F.col("neg")}, inclusive=False)
    first = hist.groupBy("part").agg(F.sum("neg").alias("N"))
    # negatives of the parts in front count in the running sums and are taken off again
    before = {name: 0 for name in probabilities}
    acc = 0
    for r in sorted(first.collect()):
        before[r["part"]], acc = acc, acc + r["N"]
    offsets = scored.sparkSession.createDataFrame(list(before.items()), "part string, _before bigint")
    pos, neg, nb = F.col("pos").cast(D38), F.col("neg").cast(D38), (F.col("neg_below") - F.col("_before")).cast(D38)
    q = clipped("score")
    ll = F.col("pos") * -F.log(q) + F.col("neg") * -F.log(1.0 - q)
    agg = offsets.join(below, "part", "left").groupBy("part").agg(
        F.sum(2 * pos * nb + pos * neg).alias("num"), F.sum(pos).alias("P"), F.sum(neg).alias("N"), F.sum(ll).alias("ll"))
    return agg.select("part", (F.col("P") + F.col("N")).cast("bigint").alias("n"), F.col("P").cast("bigint").alias("positives"),
                      F.try_divide(F.col("num").cast("double"), (2 * F.col("P") * F.col("N")).cast("double")).alias("roc_auc"),
                      F.try_divide(F.col("ll"), (F.col("P") + F.col("N")).cast("double")).alias("log_loss"))


def evaluator_auc(predictions: DataFrame, label: str = "label",
                  raw: str = "probability", exact: bool = True) -> float:
    """Spark ML's evaluator; ``numBins=0`` makes it exact (no down-sampling)."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    ev = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol=raw,
                                       metricName="areaUnderROC",
                                       numBins=0 if exact else 1000)
    return float(ev.evaluate(predictions.withColumn(label, F.col(label).cast("double"))))
