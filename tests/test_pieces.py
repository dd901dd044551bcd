"""Pieces beside the workers: sums against plain loops, lost files, and the whole count of rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from impressa.operators import boosting, pieces
from impressa.operators.pieces import Pieces, Tree


def test_regularised_trees_grow_all_rounds(spark, monkeypatch):
    """the query fits with the settings as they are, 200 rounds among them."""
    from impressa.plans import catalog

    asked = []
    df = spark.createDataFrame([(i, i % 2, i % 7) for i in range(60)], "event_id long, label int, a long")
    monkeypatch.setattr(catalog, "_asis_values", lambda *a: (df, df))
    monkeypatch.setattr(catalog, "FEATURE_COLS", ["a"])
    fit = boosting.fit
    monkeypatch.setattr(boosting, "fit", lambda train, features, p: asked.append(p) or fit(train, features, boosting.BoostParams(rounds=1, max_depth=1)))
    got = catalog.QUERIES["m4_regularised_trees"](spark, "").collect()
    assert asked == [boosting.BoostParams()] and asked[0].rounds == 200 == got[0]["rounds"] and got[0]["n"] == 60


@pytest.mark.parametrize("n, features", [(40, 3), (3000, 5), (3000, 4)])
def test_paired_sums_equal_plain_ones(n, features):
    """Many rows are added up two features at a time, few one at a time."""
    rng = np.random.default_rng(n)
    cells, nodes = 9, np.array([3, 5])
    bins = rng.integers(0, cells, (features, n)).astype(np.uint8)
    rows, at = np.flatnonzero(rng.random(n) < 0.8).astype(np.int32), rng.integers(3, 7, n)
    w = rng.integers(-2**40, 2**40, n)
    got = dict(pieces.add_up([(bins, pieces.paired(bins, cells), rows, at[rows].astype(np.uint8), [w[rows].astype(float)])] * 2, nodes, 7, cells))
    for node in nodes.tolist():
        own = rows[at[rows] == node]
        for f in range(features):
            for b in range(cells):
                hit = own[bins[f, own] == b]
                assert got[node][:, f, b].tolist() == [2 * len(hit), 2 * int(w[hit].sum())]


def test_shifted_bins_send_the_missing_either_way():
    bins = np.array([[0, 1, 2, 3]], np.uint8)
    for shift, cut, want in ((0, 2, [1, 1, 1, 2]), (1, 1, [2, 1, 1, 2])):
        tree = Tree(np.array([0, -1, -1], np.int16), np.array([cut, 0, 0], np.uint8), np.zeros(3), np.array([shift, 0, 0], np.uint8))
        assert pieces.ends(bins, np.arange(4), tree).tolist() == want


def test_lost_pieces_are_read_again(spark, monkeypatch):
    """Files that vanish between rounds change nothing: pieces come from their source, scores from all trees."""
    df = spark.createDataFrame([(i, int(i * 7 % 11 < 4), i % 13, None if i % 5 == 0 else i % 3) for i in range(400)], "event_id long, label int, a long, b long")
    p = boosting.BoostParams(rounds=5, max_depth=3, min_child_weight=1, alpha=0, reg_lambda=1, eta=0.5, gamma=0)
    want, level, lost = boosting.fit(df, ["a", "b"], p).trees, Pieces.level, []

    def losing(self, nodes, count, above, grown, depth, best, driver_bytes):
        if len(self.trees) == 3 and depth == 1 and not lost:
            name = self.name
            lost.append(name)
            self.ids.foreachPartition(lambda part: [pieces.shutil.rmtree(pieces._folder(name), ignore_errors=True) for _ in (list(part),)])
        return level(self, nodes, count, above, grown, depth, best, driver_bytes)

    monkeypatch.setattr(Pieces, "level", losing)
    assert boosting.fit(df, ["a", "b"], p).trees == want and lost


def test_null_keys_are_never_drawn_and_odd_keys_are_as_in_the_column_form(spark):
    df = spark.createDataFrame([(None if i % 10 == 0 else f"key {i} é", i % 2, i % 7) for i in range(300)], "k string, label int, a long")
    p = boosting.BoostParams(rounds=1, max_depth=1, min_child_weight=1, alpha=0, reg_lambda=1, gamma=0)
    assert boosting.fit(df, ["a"], p, key="k").trees[0][0]["n"] == df.where(boosting.drawn_rows(df, "k", p.subsample, 0)).count()
    everyone = boosting.BoostParams(rounds=1, max_depth=1, subsample=1)
    assert boosting.fit(df, ["a"], everyone, key="k").trees[0][0]["n"] == 300


def test_nan_has_a_bin_of_its_own(spark):
    df = spark.range(200).select(F.col("id").alias("event_id"), (F.col("id") % 2).cast("int").alias("label"),
                                 F.when(F.col("id") == 7, float("nan")).otherwise(F.col("id") % 9).cast("double").alias("a"))
    p = boosting.BoostParams(rounds=1, max_depth=2, min_child_weight=1, alpha=0, reg_lambda=1, gamma=0, subsample=1)
    assert boosting.fit(df, ["a"], p).trees[0][0]["n"] == 200
