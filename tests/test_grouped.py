"""Models from group counts against fits on the rows themselves; one-hot at any width."""

import math

import pytest
from pyspark.sql import functions as F

from impressa.operators import grouped, linear, metrics, onehot, sampling
from impressa.session import staging_dir


def hashed_rows(spark, n=600, m=40):
    rows = [(i, (i * 7 + i // 5) % 3 == 0, sorted({(i * k + k * k) % m for k in range(1, 6)}) if i % 11 else [], i % 4) for i in range(n)]
    rows = [(i, int(y), ix, g) for i, y, ix, g in rows]
    return spark.createDataFrame([*rows, (n, None, [1, 2], 0), (n + 1, 1, [1, 2], None)], "event_id long, label int, indices array<int>, g int")


@pytest.mark.parametrize("uses", [[[1, 2, 3], [0, 2, 3], [0, 1, 3], [0, 1, 2]], [[0], [0, 1], [0, 1, 2], [0, 1, 2, 3]]])
def test_models_equal_fits_on_their_rows(spark, uses):
    m, df = 50, hashed_rows(spark)
    counts, n1, n0 = grouped.group_counts(df, "g", 4)
    models = grouped.fit_from_counts(counts, n1, n0, uses, m, [1.0, 2.5])
    test = df.where("label IS NOT NULL").select("event_id", "label", "indices", (F.col("event_id") % 8).cast("int").alias("which"))
    got = {r["event_id"]: r for r in grouped.scores(test, models, [*range(len(models)), F.col("which")]).collect()}
    for k, use in enumerate(uses):
        own = df.where(F.col("label").isNotNull() & F.col("g").isin(use))
        for j, alpha in enumerate((1.0, 2.5)):
            one = linear.fit_bernoulli_bayes(own, m, alpha=alpha)
            for r in linear.linear_scores(test, one, key="event_id").collect():
                mine = got[r["event_id"]]
                # indices that only other groups hold are rounded one by one, not as a sum
                assert abs(mine[f"score_{2 * k + j}"] - r["score"]) <= m
    n = len(models)
    assert all(r[f"score_{n}"] == r[f"score_{r['event_id'] % 8}"] for r in got.values())


def test_scores_refuse_models_beyond_the_bound(spark):
    df = hashed_rows(spark, 40)
    counts, n1, n0 = grouped.group_counts(df, "g", 4)
    models = grouped.fit_from_counts(counts, n1, n0, [[0], [1]], 50, [1.0])
    with pytest.raises(ValueError):
        grouped.scores(df, models, [0], dense_max=99)


def test_one_hot_labels_by_frequency_then_value(spark):
    rows = [(1, "b", "x"), (2, "a", None), (3, "a", "x"), (4, "c", "y"), (5, None, "z"), (6, "b", "x")]
    df = spark.createDataFrame(rows, "k long, u string, v string")
    d = onehot.dictionary(df, ["u", "v"])
    assert {(r["col"], r["value"]): (r["label"], r["n"]) for r in d.collect()} == {
        (0, "a"): (0, 2), (0, "b"): (1, 2), (0, "c"): (2, 1), (1, "x"): (0, 3), (1, "y"): (1, 1), (1, "z"): (2, 1)}
    new = spark.createDataFrame([*rows, (7, "new", "y")], "k long, u string, v string")
    got = {r["k"]: r["positions"] for r in onehot.encode(new, d, ["u", "v"], "k").collect()}
    assert got == {1: [1, 4], 2: [0, 7], 3: [0, 4], 4: [2, 5], 5: [3, 6], 6: [1, 4], 7: [3, 5]}
    assert {r["feature"]: (r["n_labels"], r["category_size"]) for r in onehot.widths(d, ["u", "v"]).collect()} == {"u": (3, 4), "v": (3, 4)}
    none = onehot.dictionary(df.limit(0), ["u", "v"])
    assert none.count() == 0 and {r["category_size"] for r in onehot.widths(none, ["u", "v"]).collect()} == {1}


def test_one_hot_of_a_column_above_a_million_labels(spark):
    n = 1_200_000
    df = spark.range(n).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("v"), "id")).alias("c"))
    d = onehot.dictionary(df, ["c"])
    path = staging_dir(spark, "labels")
    d.write.parquet(path)
    d = spark.read.parquet(path)
    labels = 1 + n - math.ceil(n / 3)
    assert onehot.widths(d, ["c"]).first()["n_labels"] == labels
    got = onehot.encode(df, d, ["c"], "k").agg(F.count("*").alias("n"), F.sum((F.col("positions")[0] == 0).cast("int")).alias("hot"),
                                               F.count_distinct(F.col("positions")[0]).alias("places")).first()
    assert (got["n"], got["hot"], got["places"]) == (n, math.ceil(n / 3), labels)


def test_the_weights_of_all_models_are_no_column_of_the_rows(spark):
    df = hashed_rows(spark, 60)
    counts, n1, n0 = grouped.group_counts(df, "g", 4)
    models = grouped.fit_from_counts(counts, n1, n0, [[0], [1], [2]], 50, [1.0])
    path = staging_dir(spark, "grouped-rows")
    df.write.parquet(path)
    for pick in ([0, 1, 2], [F.col("g"), F.lit(2) - F.col("g")]):
        scored = grouped.scores(spark.read.parquet(path), models, pick)
        assert " AS _w#" not in scored._jdf.queryExecution().optimizedPlan().toString()


def test_sample_members_are_the_exact_sample_and_settle_equal_keys(spark, monkeypatch):
    monkeypatch.setattr(sampling, "ROWS_A_BUCKET", 50)
    path = staging_dir(spark, "member-rows")
    spark.range(700).select((F.col("id") % 350).alias("event_id"), F.col("id").alias("_row")).write.parquet(path)
    df = spark.read.parquet(path)
    sizes = {"1": 1, "101": 101, "699": 699, "9k": 9000}
    for name, member in sampling.sample_members(df, "event_id", sizes, "_row", 700).items():
        rows = [r["event_id"] for r in df.where(member).collect()]
        want = [r["event_id"] for r in sampling.exact_sample(df, "event_id", sizes[name], name, 700).collect()]
        assert sorted(rows) == sorted(want)
    with pytest.raises(sampling.SampleShort):
        sampling.sample_members(df, "event_id", {"800": 800}, "_row", 900)


def test_overlapping_groups_give_the_fits_and_metrics_of_their_rows(spark):
    m, df = 50, hashed_rows(spark).where("label IS NOT NULL")
    members = [F.col("event_id") % 2 == 0, F.col("event_id") % 3 == 0, F.lit(True), F.col("event_id") < 5]
    counts, n1, n0 = grouped.member_counts(df, members)
    models = grouped.fit_from_counts(counts, n1, n0, [[k] for k in range(len(members))], m, [1.0], seen_only=True)
    scored = grouped.scores(df, models, list(range(len(members))))
    got = {r["part"]: r for r in metrics.many_metrics(scored, {str(k): linear.sigmoid_fixed(F.col(f"score_{k}")) for k in range(len(members))}).collect()}
    for k, member in enumerate(members):
        one = linear.linear_scores(df, linear.fit_bernoulli_bayes(df.where(member), m), key="event_id")
        assert {(r[0], r[1]) for r in one.select("event_id", "score").collect()} == {(r[0], r[1]) for r in scored.select("event_id", f"score_{k}").collect()}
        want = metrics.binary_metrics(one).first()
        assert (got[str(k)]["n"], got[str(k)]["positives"], got[str(k)]["roc_auc"]) == (want["n"], want["positives"], want["roc_auc"])
        assert math.isclose(got[str(k)]["log_loss"], want["log_loss"], rel_tol=1e-12)
