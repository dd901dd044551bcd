"""Distributed learners and evaluation on Spark ML.

Classifier settings are the reference's (fixed values below).  Models score
with ``model.transform`` (a narrow map; coefficients travel in the task
closure) and evaluation is the exact distributed metric operator: no score
ever reaches the driver.
"""

from __future__ import annotations

import contextlib
import time

from pyspark import StorageLevel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, NaiveBayes
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from impressa.functions.vectors import positive_probability
from impressa.operators import forests, gbt, metrics

SEED = 42

# Classifier parameters used by the reference's experiments.
LR_PARAMS = dict(regParam=0.03)
RF_PARAMS = dict(featureSubsetStrategy="sqrt", impurity="entropy", minInstancesPerNode=3,
                 maxBins=64, maxDepth=10, numTrees=160)
# Boosted trees with logistic loss: depth 7, 200 rounds, eta 0.2, row subsample
# 0.8, column subsample 0.8; split loss reduction 0.4 and child weight 20 are
# sums over rows, see ``gbt_limits``.  (No L1/L2 leaf penalties, as in Spark ML.)
GBT_PARAMS = dict(maxDepth=7, maxIter=200, stepSize=0.2, subsamplingRate=0.8,
                  featureSubsetStrategy="0.8")
GBT_GAMMA, GBT_CHILD_WEIGHT = 0.4, 20


def gbt_limits(rows: int) -> dict:
    """Spark's per-row forms of the split limits for ``rows`` train rows (approximate).

    A row weighs at most 1/4 in the child weight (logistic loss), so a child
    needs four times as many rows.
    """
    rows = max(1, rows)
    return dict(minInfoGain=GBT_GAMMA / rows, minWeightFractionPerNode=min(0.49, 4 * GBT_CHILD_WEIGHT / rows))


def make_classifier(kind: str, rows: int | None = None, **overrides):
    """M1 'lr', M2 'rf', M4 'gbt', M5 'tree' / 'bayes'; ``rows``: train rows, for the limits of 'gbt'."""
    if kind == "lr":
        return LogisticRegression(**{**LR_PARAMS, **overrides})
    if kind == "rf":
        return forests.RandomForest(seed=SEED, **{**RF_PARAMS, **overrides})
    if kind == "gbt":
        return gbt.BoostedTrees(seed=SEED, **{**GBT_PARAMS, **(gbt_limits(rows) if rows else {}), **overrides})
    if kind == "tree":
        return DecisionTreeClassifier(seed=SEED, **overrides)
    if kind == "bayes":
        return NaiveBayes(**{"modelType": "bernoulli", **overrides})
    raise ValueError(f"unknown classifier {kind!r}")


@contextlib.contextmanager
def persisted(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK):
    """Scoped caching: ``with persisted(df) as d: ...`` unpersists on exit.

    Safe under executor loss because every cached input here is a
    deterministic function of its source (lost blocks are recomputed equal).
    """
    df.persist(level)
    try:
        yield df
    finally:
        df.unpersist()


def input_level(kind: str) -> StorageLevel:
    """Where a fit's input is kept.  Logistic regression keeps blocks of its own in memory and reads its
    input twice; a second copy in memory would push the blocks, read in every iteration, to disk."""
    return StorageLevel.DISK_ONLY if kind == "lr" else StorageLevel.MEMORY_AND_DISK


def fit_timed(classifier, train: DataFrame):
    """Fit and return (model, seconds of the fit alone)."""
    t0 = time.perf_counter()
    model = classifier.fit(train)
    return model, time.perf_counter() - t0


def predictions(model, df: DataFrame, key: str | None = None) -> DataFrame:
    """(key?, label, p) from ``model.transform``."""
    cols = ([key] if key else []) + [F.col("label").cast("int").alias("label"),
                                     positive_probability("probability").alias("p")]
    return model.transform(df).select(*cols)


def evaluate(model, **parts: DataFrame) -> dict[str, Row]:
    """For each named part its (n, positives, roc_auc, log_loss), exact and distributed."""
    scored = {name: predictions(model, df) for name, df in parts.items()}
    return {r["part"]: r for r in metrics.by_part(scored, metrics.binary_metrics).collect()}
