import random

from pyspark.sql import functions as F

from impressa.operators import ordering, sampling


def _ids(spark, n):
    return spark.range(n).withColumnRenamed("id", "k").repartition(4)


def test_exact_sample_sizes(spark):
    df = _ids(spark, 500)
    for n in (0, 1, 37, 499, 500, 800):
        assert sampling.exact_sample(df, "k", n, salt=str(n)).count() == min(n, 500)
    empty = spark.createDataFrame([], "k bigint")
    assert sampling.exact_sample(empty, "k", 10, salt="x").count() == 0


def test_exact_sample_takes_the_smallest_hashes_and_rejects_null_keys(spark):
    import hashlib

    import pytest

    df = _ids(spark, 2000)
    got = {r.k for r in sampling.exact_sample(df, "k", 300, salt="s").collect()}
    assert got == set(sorted(range(2000), key=lambda k: hashlib.md5(f"s:{k}".encode()).hexdigest())[:300])
    with pytest.raises(Exception, match="null sampling key"):
        sampling.exact_sample(df.selectExpr("nullif(k, 7) AS k"), "k", 300, salt="s").collect()
    with pytest.raises(sampling.SampleShort):
        sampling.exact_sample(df, "k", 3000, salt="s", total=5000)


def test_sample_is_deterministic_and_salted(spark):
    df = _ids(spark, 1000)
    a = {r.k for r in sampling.exact_sample(df, "k", 100, salt="10k").collect()}
    b = {r.k for r in sampling.exact_sample(df, "k", 100, salt="10k").collect()}
    c = {r.k for r in sampling.exact_sample(df, "k", 100, salt="30k").collect()}
    assert a == b and a != c


def test_global_index_matches_row_number_with_hot_key(spark):
    rnd = random.Random(1)
    # one key value holds a third of the rows
    rows = [(0 if i % 3 == 0 else rnd.randint(1, 50), i) for i in range(900)]
    df = spark.createDataFrame(rows, "g bigint, k bigint").repartition(5)
    got = {r.k: r.row_idx for r in ordering.global_index(df, ["g", "k"], "row_idx", ranges=7).collect()}
    want = sorted(rows)
    assert got == {k: i for i, (_, k) in enumerate(want)}


def test_global_index_with_large_ids_and_null_keys(spark):
    rows = [(None if i % 5 == 0 else (1 << 33) + i % 3, (1 << 40) + i) for i in range(200)]
    df = spark.createDataFrame(rows, "g bigint, k bigint").repartition(5)
    got = {r.k: r.row_idx for r in ordering.global_index(df, ["g", "k"], "row_idx", ranges=6).collect()}
    assert got == {k: i for i, (_, k) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])))}


def test_take_first_any_n(spark):
    df = _ids(spark, 500)
    for n in (0, 1, 250, 499, 500, 900):
        assert sorted(r.k for r in ordering.take_first(df, ["k"], n, ranges=6).collect()) == list(range(min(n, 500)))


def test_prefix_sums_inclusive_exclusive(spark):
    df = spark.createDataFrame([(i, i % 4) for i in range(200)], "k bigint, v bigint")
    inc = ordering.prefix_sums(df, ["k"], {"c": F.col("v")}, inclusive=True, ranges=6)
    exc = ordering.prefix_sums(df, ["k"], {"c": F.col("v")}, inclusive=False, ranges=6)
    run, want_inc, want_exc = 0, {}, {}
    for i in range(200):
        want_exc[i] = run
        run += i % 4
        want_inc[i] = run
    assert {r.k: r.c for r in inc.collect()} == want_inc
    assert {r.k: r.c for r in exc.collect()} == want_exc


def test_shuffle_is_a_bijection(spark):
    df = _ids(spark, 300)
    idx = ordering.global_index(df, ["k"], "row_idx", ranges=4)
    sh = ordering.shuffle_order(idx, "row_idx", "pos", ranges=4).collect()
    assert sorted(r.pos for r in sh) == list(range(300))
    import hashlib
    want = sorted(range(300), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    assert [r.row_idx for r in sorted(sh, key=lambda r: r.pos)] == want


def test_holdout_split_disjoint(spark):
    df = spark.createDataFrame([(i, i % 5) for i in range(100)], "k bigint, day int")
    train, test = sampling.holdout_split(df)
    assert test.agg(F.min("day")).first()[0] == 4
    assert train.agg(F.max("day")).first()[0] == 3
    assert train.count() + test.count() == 100


def test_bernoulli_fraction_bounds(spark):
    df = _ids(spark, 1000)
    assert sampling.bernoulli_sample(df, "k", 0.0, "a").count() == 0
    assert sampling.bernoulli_sample(df, "k", 1.0, "a").count() == 1000


def test_exact_sample_widens_a_short_prefilter(spark):
    df = _ids(spark, 1000)
    # an undersized pre-filter must be widened until n rows are available
    got = {r.k for r in sampling.exact_sample(df, "k", 400, salt="w", oversample=0.25).collect()}
    want = {r.k for r in sampling.exact_sample(df, "k", 400, salt="w").collect()}
    assert got == want and len(got) == 400


def test_pairing_checks_alignment(spark):
    import pytest

    from impressa.operators.pairing import UNALIGNED, pair_by_key

    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "k bigint, label int")
    scores = spark.createDataFrame([(i, 0.1 * i) for i in range(9)], "k bigint, p double")
    repeated = labels.where("k < 9").union(labels.where("k = 0"))
    for a, b in ((labels, scores), (scores, labels), (repeated, labels), (labels, repeated)):
        with pytest.raises(Exception, match=UNALIGNED):
            pair_by_key(a, b, "k").collect()
    assert pair_by_key(labels, scores.union(spark.createDataFrame([(9, .9)], "k bigint, p double")),
                       "k").count() == 10


def test_exact_samples_equal_one_by_one(spark):
    df = spark.range(2000).withColumn("x", F.col("id") * 2)
    sizes = {"0": 0, "7": 7, "100": 100, "1k": 1000, "3k": 3000}
    got = sampling.exact_samples(df, "id", sizes)
    for s, n in sizes.items():
        want = {r.id for r in sampling.exact_sample(df, "id", n, salt=s).collect()}
        rows = got[s].collect()
        assert got[s].columns == df.columns and len(rows) == min(n, 2000) and {r.id for r in rows} == want
