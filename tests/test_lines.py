"""File-order index and positional pairing against the RDD forms that define them."""

import random

import pytest

from impressa.session import staging_dir
from impressa.sources import lines


def write_files(path, files):
    import os

    os.makedirs(path)
    for k, rows in enumerate(files):
        with open(os.path.join(path, f"part-{k:05d}"), "w", newline="") as f:
            f.write("".join(f"{r}\n" for r in rows))


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def same_as_rdd(spark, path):
    import os

    files = ",".join(os.path.join(path, f) for f in sorted(os.listdir(path)))  # a local folder lists its files in no order
    got = sorted((r["line_no"], r["value"]) for r in lines.numbered_lines(spark, path).collect())
    return got == [(i, x) for x, i in spark.sparkContext.textFile(files).zipWithIndex().collect()]


@pytest.mark.parametrize("sizes", [(5, 50_000, 500), (1, 0, 3000, 2, 0), (7,)])
def test_index_equals_zip_with_index_on_unequal_files(spark, small_splits, sizes):
    path = staging_dir(spark, "unequal")
    write_files(path, [[f"{k} {i}" if i % 7 else "" for i in range(n)] for k, n in enumerate(sizes)])
    assert same_as_rdd(spark, path)


def test_index_of_compressed_files_odd_line_ends_and_repeats(spark, small_splits):
    import gzip
    import os

    path = staging_dir(spark, "odd")
    write_files(path, [["same"] * 4000, ["x\r", "é" * 5000, "", "last"]])
    with gzip.open(os.path.join(path, "part-00000a.gz"), "wt") as f:
        f.write("zipped\n" * 3000)
    assert same_as_rdd(spark, path)


def test_no_lines(spark):
    path = staging_dir(spark, "none")
    write_files(path, [[], []])
    assert lines.numbered_lines(spark, path).count() == 0


def test_pairing_of_files_split_differently(spark, small_splits):
    n = 20_000
    rng = random.Random(0)
    y, p = [rng.randint(0, 1) for _ in range(n)], [rng.random() for _ in range(n)]
    a, b = staging_dir(spark, "labels"), staging_dir(spark, "scores")
    write_files(a, [[f"{x} id" for x in y[:5]], [f"{x}" for x in y[5:]]])
    write_files(b, [[repr(x) for x in p[i * 4000:(i + 1) * 4000]] for i in range(5)])
    got = sorted((r["line_no"], r["label"], r["score"]) for r in lines.pair_files(spark, a, b).collect())
    assert got == [(i, y[i], p[i]) for i in range(n)]


def test_unequal_lengths_raise(spark):
    a, b = staging_dir(spark, "labels"), staging_dir(spark, "scores")
    write_files(a, [["1"] * 10])
    write_files(b, [["0.5"] * 9])
    for x, y in ((a, b), (b, a)):
        with pytest.raises(Exception, match=lines.UNEQUAL):
            lines.pair_files(spark, x, y).collect()


def test_lines_are_neither_staged_nor_shuffled(spark, small_splits):
    """only the splits are written and sent; the text stays in its file until its index is known."""
    path = staging_dir(spark, "narrow")
    write_files(path, [["x" * 50] * 2000, ["y" * 50] * 700])
    plan = lines.numbered_lines(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert "FileScan text" in plan


def test_days_are_cut_and_encoded_in_order(spark, tmp_path):
    """events are put in order while narrow, by day and id, a day over several tasks."""
    import datetime

    from impressa.sources.events import impressions_by_day

    start = datetime.datetime(2024, 1, 1)
    ids = random.Random(1).sample(range(400), 400)
    rows = [(i, start + datetime.timedelta(days=i % 2, minutes=i), i % 9, "click", float(i), '{"k": %d}' % (i % 100)) for i in ids]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    got = [(r.day, r.event_id) for r in impressions_by_day(spark, str(tmp_path)).select("day", "event_id").collect()]
    assert got == sorted(got) and sorted(i for _, i in got) == list(range(400))
