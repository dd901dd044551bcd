"""Level-wise boosted trees: against Spark ML's, against other pieces, tasks and chains, and what a level shuffles."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from impressa.operators import gbt, learn, metrics
from impressa.operators.gbt import BoostedTrees

KEEP_ALL = dict(subsamplingRate=1.0, featureSubsetStrategy="all")


def table(spark, n, parts=3, values=20):
    rng = np.random.default_rng(5)
    x = np.stack([rng.integers(0, 3, n), rng.integers(-values // 2, values // 2, n) / 4, rng.integers(0, values, n) * 500 // values, np.zeros(n)], axis=1).astype(float)
    y = (rng.random(n) < 1 / (1 + np.exp(-(2 * (x[:, 0] == 1) + 1.5 * x[:, 1] - 0.004 * x[:, 2])))).astype(int)
    rows = spark.createDataFrame([(i, float(b), [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y))], "event_id long, label double, x array<double>")
    return rows.repartition(parts, "event_id").select("event_id", "label", array_to_vector("x").alias("features"), "x")


def scores(model, rows):
    return np.array([r["p"] for r in learn.predictions(model, rows, "event_id").orderBy("event_id").collect()])


def test_the_query_fits_trees_whose_rounds_cost_a_job_a_level(spark):
    """Spark ML's own fit fails by time; every setting of it is kept."""
    fit = learn.make_classifier("gbt", 100_000)
    assert isinstance(fit, BoostedTrees)
    assert {k: getattr(fit, k) for k in learn.GBT_PARAMS} == learn.GBT_PARAMS
    assert {k: getattr(fit, k) for k in learn.gbt_limits(100_000)} == learn.gbt_limits(100_000)
    assert (fit.seed, fit.maxBins, fit.minInstancesPerNode) == (learn.SEED, 32, 1) and fit.drawn_features(40) == 32 and fit.drawn_features(3) == 3


@pytest.mark.parametrize("limits", [{}, {"minInfoGain": 0.02, "minWeightFractionPerNode": 0.05}, {"minInstancesPerNode": 30}])
def test_equals_spark_mls_where_nothing_is_drawn(spark, limits):
    """Few values a feature: both cut at the midpoints, so all probabilities are the same."""
    rows = table(spark, 800).cache()
    over = dict(KEEP_ALL, maxIter=6, maxDepth=3, stepSize=0.2, maxBins=32, **limits)
    ours, theirs = (scores(c.fit(rows), rows) for c in (BoostedTrees(**over), GBTClassifier(seed=1, **over)))
    assert abs(ours - theirs).max() < 1e-6 and ours.std() > 0.1


def test_as_good_as_spark_mls_with_draws_and_many_values(spark):
    rows = table(spark, 3000, values=2000).cache()
    train, test = rows.where("event_id % 5 <> 0"), rows.where("event_id % 5 = 0")
    over = {**learn.GBT_PARAMS, **learn.gbt_limits(2400), "maxIter": 15, "maxDepth": 4}
    fits = [BoostedTrees(seed=42, **over), GBTClassifier(seed=42, **over), GBTClassifier(seed=7, **over)]
    models = [c.fit(train) for c in fits]
    p, q, r = (scores(m, test) for m in models)
    assert abs(p - q).mean() < 1.5 * abs(q - r).mean() and np.corrcoef(p, q)[0, 1] > 0.97
    a, b = (metrics.binary_metrics(learn.predictions(m, test), "label", "p").first() for m in models[:2])
    assert abs(a["roc_auc"] - b["roc_auc"]) < 0.02 and abs(a["log_loss"] - b["log_loss"]) < 0.02


def test_pieces_tasks_and_chains_do_not_change_a_fit(spark, monkeypatch):
    rows = table(spark, 700).cache()
    p = BoostedTrees(maxIter=5, maxDepth=3, featureSubsetStrategy="0.5", stepSize=0.3)
    expected = scores(p.fit(rows), rows)
    monkeypatch.setattr(gbt, "ROWS_A_PIECE", 40)
    monkeypatch.setattr(gbt, "ROUNDS_A_CHAIN", 2)
    monkeypatch.setattr(gbt, "DRIVER_BYTES", 0)
    assert (scores(p.fit(rows.repartition(7)), rows) == expected).all()


def test_rows_are_drawn_anew_for_each_tree():
    a, b, c = (gbt.drawn_rows(piece, 100_000, 42, tree, 0.8) for piece, tree in ((0, 0), (0, 1), (1 << 33, 0)))
    for x in (a, b, c):
        assert abs(x.mean() - 0.8) < 0.01
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.02 and abs(np.corrcoef(a, c)[0, 1]) < 0.02
    assert gbt.drawn_rows(3, 1000, 42, 5, 1.0).all() and (a == gbt.drawn_rows(0, 100_000, 42, 0, 0.8)).all()


def test_a_level_shuffles_sums_not_rows(spark):
    """A task's sums are as many and as long for 300 rows as for 3000."""
    sizes = {}
    for n in (300, 3000):
        p = BoostedTrees(maxBins=8)
        pieces = p.pieces(table(spark, n).select("label", "x"), [np.array([0.5, 1.5]), np.array([0.0]), np.array([250.0]), np.array([])])
        state = pieces.rdd.map(gbt._unpack).coalesce(1).mapPartitions(lambda part: gbt._step(part, [], p, 0))
        feature, cut = np.array([1, -1, -1], np.int16), np.zeros(3, np.uint8)
        sums = state.mapPartitions(lambda part: gbt._sums(part, np.array([1, 2]), feature, cut, 8)).collect()
        sizes[n] = [(node, s.shape) for node, s in sums]
        assert sum(int(s[0, 0].sum()) for _, s in sums) == n
    assert sizes[300] == sizes[3000] == [(1, (2, 4, 8)), (2, (2, 4, 8))]


def test_odd_inputs(spark):
    rows = table(spark, 60)
    with pytest.raises(ValueError, match="no rows"):
        BoostedTrees().fit(rows.where("false"))
    with pytest.raises(Exception, match="neither 0 nor 1"):
        BoostedTrees(maxIter=2).fit(rows.withColumn("label", F.lit(2.0)))
    over = dict(KEEP_ALL, maxIter=3, maxDepth=2, stepSize=0.2)
    for label in (0.0, 1.0):
        same = rows.withColumn("label", F.lit(label))
        ours, theirs = (scores(c.fit(same), same) for c in (BoostedTrees(**over), GBTClassifier(**over)))
        assert abs(ours - theirs).max() < 1e-9
    stump = BoostedTrees(maxIter=2, maxDepth=0).fit(rows)
    assert len(set(scores(stump, rows))) == 1
    with pytest.raises(ValueError):
        BoostedTrees(featureSubsetStrategy="1.5")
    with pytest.raises(ValueError):
        BoostedTrees(maxIter=0)
