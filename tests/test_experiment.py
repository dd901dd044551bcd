"""Sweeps read all train rows, however many there are."""

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import functions as F

from impressa.functions import hashing
from impressa.operators import sampling
from impressa.plans import experiment
from impressa.schema import CATEGORICAL_COLS, NUMERIC_COLS


@pytest.fixture
def train(spark, monkeypatch):
    """300 train rows in place of a table; a sample would come out at 50 at most."""
    rows = spark.range(300).select(F.col("id").alias("event_id"), (F.col("id") % 3 == 0).cast("double").alias("label"), (F.col("id") % 7).cast("double").alias("x"))
    rows = rows.selectExpr("event_id", "label", "array(x, label * 0.1 + x % 2) AS v")
    data = rows.select("event_id", "label", array_to_vector("v").alias("features"))
    monkeypatch.setattr(experiment, "ml_datasets", lambda *a, **k: (data, data.limit(10)))
    exact = sampling.exact_sample
    monkeypatch.setattr(sampling, "exact_sample", lambda df, key, n, salt, *a, **k: exact(df, key, min(n, 50), salt, *a, **k))
    return data


def test_parallelism_sweep_fits_on_all_rows(spark, train):
    got = experiment.parallelism_sweep(spark, "", (1, 2)).collect()
    assert [(r["tasks"], r["train_rows"]) for r in got] == [(1, 300), (2, 300)]


@pytest.mark.parametrize("kind, grid", [("lr", {"regParam": (0.01, 0.1)}), ("tree", {"maxDepth": (1, 2), "maxBins": (8, 16)})])
def test_cross_validation_reads_all_rows(spark, train, monkeypatch, kind, grid):
    seen, fit = [], CrossValidator.fit
    monkeypatch.setattr(CrossValidator, "fit", lambda self, df, *a: seen.append(df.count()) or fit(self, df, *a))
    got = experiment.cross_validate(spark, "", kind, grid, folds=2).collect()
    assert seen == [300] and len(got) == (2 if kind == "lr" else 4) and all(r["cv_log_loss"] > 0 for r in got)


def test_packed_hash_spaces_equal_the_expressions(spark):
    """Null and malformed values, doubled tokens, rows without any token."""
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else i * 17 - 40, "zz" if i % 4 == 0 else None if i % 6 == 1 else f"{i * 7919:x}") for i in range(200)],
                                 "event_id long, a long, c14 string")
    tokens = [*hashing.token_sql(numeric=[], categorical=["c14"]), "concat('1_', a)", "concat('1_', a)", "concat('2_', CASE WHEN a > 500 THEN a END)"]
    spaces = {"few": 5, "many": 100_000, "most": 1 << 31}
    want = hashing.with_hash_spaces(rows, spaces, tokens).select("event_id", *spaces)
    got = hashing.packed_hash_spaces(rows.repartition(3), spaces, "event_id", tokens=tokens)
    assert [f.dataType.simpleString() for f in got.schema] == [f.dataType.simpleString() for f in want.schema]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert [] in [r["few"] for r in got.collect()]
    with pytest.raises(ValueError):
        hashing.packed_hash_spaces(rows, {"x": (1 << 31) + 1}, "event_id", tokens=tokens)


def test_a_sweep_hashes_once_and_samples_as_one_by_one(spark, monkeypatch):
    """one staging of hashed rows and one draw a size serve all hash spaces."""
    events = spark.range(1200).selectExpr("id AS event_id", "cast(id % 3 AS int) AS day", "cast(id % 2 AS int) AS label",
                                          *[f"id % {7 + k} AS {c}" for k, c in enumerate(NUMERIC_COLS)], *[f"lpad(hex(id % {5 + k}), 8, '0') AS {c}" for k, c in enumerate(CATEGORICAL_COLS)])
    reads, draws, exact = [], [], sampling.exact_sample
    monkeypatch.setattr(experiment, "load_impressions", lambda *a: reads.append(1) or events)
    monkeypatch.setattr(sampling, "exact_sample", lambda df, key, n, *a, **k: draws.append(n) or exact(df, key, n, *a, **k))
    got = experiment.ml_sweep(spark, "", ["lr"], [50, 300, 1000], overrides={"lr": {"maxIter": 1}}, spaces=(100, 500), series="{}-{}").collect()
    assert [(r["engine"], r["train_size"]) for r in got] == [(f"lr-{m}", n) for m in ("100", "500") for n in (50, 300, 800)]
    assert reads == [1] and draws == [300, 1000]
    train = events.where("day < 2").select("event_id")
    for n, rows in experiment.sweep_samples(train, [50, 300, 1000], 800).items():
        assert {r[0] for r in rows.collect()} == {r[0] for r in exact(train, "event_id", n, salt=experiment.py_size_to_name(n)).collect()}
