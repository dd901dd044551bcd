import math
import random

import pytest

from impressa.operators import metrics


def _auc(spark, pairs, **kw):
    df = spark.createDataFrame(pairs, "label int, p double")
    return metrics.binary_metrics(df, "label", "p", **kw).first()


def _brute_auc(pairs):
    pos = [p for y, p in pairs if y == 1]
    neg = [p for y, p in pairs if y == 0]
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    return s / (len(pos) * len(neg))


def test_ties_perfect_inverted(spark):
    assert _auc(spark, [(0, .5), (1, .5)]).roc_auc == 0.5
    assert _auc(spark, [(0, .1), (1, .9)]).roc_auc == 1.0
    assert _auc(spark, [(1, .1), (0, .9)]).roc_auc == 0.0


def test_single_class_and_clipping(spark):
    r = _auc(spark, [(1, .3), (1, .7)])
    assert r.roc_auc is None
    assert r.log_loss == pytest.approx(-(math.log(.3) + math.log(.7)) / 2)
    r = _auc(spark, [(1, 0.0), (0, 1.0)])
    eps = 1e-15
    want = (-math.log(eps) - math.log(1.0 - (1.0 - eps))) / 2
    assert math.isfinite(r.log_loss) and r.log_loss == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("buckets", [1, 3, 16])
def test_auc_equals_brute_force(spark, buckets):
    rnd = random.Random(7)
    pairs = [(rnd.random() < .3 and 1 or 0, round(rnd.random(), 2)) for _ in range(700)]
    r = _auc(spark, pairs, buckets=buckets)
    assert r.roc_auc == pytest.approx(_brute_auc(pairs), abs=1e-12)
    flipped = _auc(spark, [(y, 1 - p) for y, p in pairs], buckets=buckets)
    assert flipped.roc_auc == pytest.approx(1 - r.roc_auc, abs=1e-12)


def test_roc_curve_monotone_and_complete(spark):
    rnd = random.Random(3)
    pairs = [(rnd.random() < .4 and 1 or 0, rnd.random()) for _ in range(300)]
    df = spark.createDataFrame(pairs, "label int, p double")
    roc = metrics.roc_curve(df, "label", "p", buckets=5).orderBy("fp", "tp").collect()
    assert (roc[0].tp, roc[0].fp) == (0, 0)
    assert (roc[-1].tpr, roc[-1].fpr) == (1.0, 1.0)
    tps = [r.tp for r in roc]
    assert tps == sorted(tps)


def test_rows_without_label_or_score_count_nowhere(spark):
    df = spark.createDataFrame([(1, .9), (0, .1), (None, .9), (1, None)], "label int, p double")
    want = (-math.log(.9) - math.log(1 - .1)) / 2
    assert metrics.log_loss(df).first().log_loss == pytest.approx(want)
    r = metrics.binary_metrics(df).first()
    assert (r.n, r.positives, r.roc_auc) == (2, 1, 1.0) and r.log_loss == pytest.approx(want)


def test_parts_are_measured_apart(spark):
    parts = {"test": [(1, .9), (0, .1)], "train": [(1, .1), (0, .9), (0, .2)]}
    frames = {k: spark.createDataFrame(v, "label int, p double") for k, v in parts.items()}
    got = {r.part: r for r in metrics.by_part(frames, metrics.binary_metrics).collect()}
    assert {k: (r.n, r.roc_auc) for k, r in got.items()} == {"test": (2, 1.0), "train": (3, 0.0)}


def test_bounded_curve_lies_on_the_exact_one_and_bounds_its_area(spark):
    rng = random.Random(3)
    rows = [(int(rng.random() < 0.3 + 0.4 * p), p) for p in (rng.choice([rng.random(), 0.5, 0.25]) for _ in range(6000))] + [(None, 0.5), (1, None)]
    df = spark.createDataFrame(rows, "label int, p double").repartition(5)
    exact = {(r["threshold"], r["tp"], r["fp"]) for r in metrics.roc_curve(df).collect()}
    auc = metrics.roc_auc(df).first()[0]
    for points in (2, 20, 500):
        curve = metrics.roc_sketch(df, points=points).collect()
        assert len(curve) <= 2 * points and {(r["threshold"], r["tp"], r["fp"]) for r in curve} <= exact
        low, high = metrics.auc_bounds(df, points=points).first()
        assert low <= auc <= high and high - low <= 1.5 / points
    low, high = metrics.auc_bounds(df.where("p = 0.5"), points=9).first()
    assert low == high == 0.5
    assert metrics.auc_bounds(df.limit(0)).first()["auc_low"] is None and metrics.roc_sketch(df.limit(0)).count() == 1
