import math

import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.sql import functions as F

from impressa.functions.vectors import positive_probability, with_binary_vector
from impressa.operators import linear


def test_sql_form_bayes_equals_spark_ml(spark):
    rows = [(i, int(i % 3 == 0), sorted({(i * 7) % 13, (i * 3) % 11, i % 5})) for i in range(120)]
    df = spark.createDataFrame(rows, "row_id bigint, label int, indices array<int>")
    m = 16
    model = linear.fit_bernoulli_bayes(df, m)
    ours = {r.row_id: r.p for r in linear.linear_scores(df, model).collect()}
    ml_in = with_binary_vector(df.withColumn("label", F.col("label").cast("double")), "indices", m)
    nb = NaiveBayes(modelType="bernoulli", smoothing=1.0).fit(ml_in)
    theirs = {r.row_id: r.p for r in nb.transform(ml_in).select(
        "row_id", positive_probability().alias("p")).collect()}
    for k in ours:
        assert ours[k] == pytest.approx(theirs[k], abs=1e-6)


def test_scores_are_order_independent(spark):
    rows = [(i, int(i % 2), [i % 7, (i + 1) % 7]) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id bigint, label int, indices array<int>")
    model = linear.fit_bernoulli_bayes(df, 7)
    a = {r.row_id: r.score for r in linear.linear_scores(df.repartition(1), model).collect()}
    b = {r.row_id: r.score for r in linear.linear_scores(df.repartition(6), model).collect()}
    assert a == b
    empty = spark.createDataFrame([(999, 0, [])], "row_id bigint, label int, indices array<int>")
    s = linear.linear_scores(empty, model).first()
    assert s.score == model.intercept and not math.isnan(s.p)


def test_scores_agree_for_array_and_joined_weights(spark):
    rows = spark.createDataFrame([(i, i % 2, [i % 7, 7 + i % 5, 12 + i % 3]) for i in range(60)] + [(60, 1, []), (61, 0, None)],
                                 "row_id long, label int, indices array<int>")
    model = linear.fit_bernoulli_bayes(rows.where("row_id < 50"), 16)
    a = linear.linear_scores(rows, model)
    assert "Exchange" not in a._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
    b = linear.linear_scores(rows, model, dense_max=0)
    assert sorted(a.collect()) == sorted(b.collect())


def test_binary_vectors_hold_every_index(spark):
    from impressa.functions import vectors

    rows = spark.createDataFrame([(1, [0, 5, 9]), (2, []), (3, None)], "k long, indices array<int>")
    out = vectors.with_binary_vector(rows, "indices", 10)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.k: r.features for r in out.collect()}
    assert got[1].indices.tolist() == [0, 5, 9] and got[1].values.tolist() == [1.0] * 3 and got[1].size == 10
    assert got[2].numNonzeros() == got[3].numNonzeros() == 0
