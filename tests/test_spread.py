"""Tasks of bounded rows, and a line parsed once."""

from pyspark.sql import functions as F

from impressa.functions import encode
from impressa.operators import learn
from impressa.sources.events import spread


def test_tasks_are_cut_by_rows_too(spark):
    df = spark.range(0, 1000, 1, 8)
    got = spread(df, rows_a_task=50)
    assert got.rdd.getNumPartitions() == 20 and got.count() == 1000
    assert spread(df, rows_a_task=500).rdd.getNumPartitions() == 8


def test_a_line_is_split_once(spark):
    rows = [("1 1:5 2:-1 39:4294967295",), ("0",), ("1  3:2",), (None,)]
    parsed = spark.createDataFrame(rows, "v string").select(encode.parse_libsvm("v").alias("r"))
    assert [(r["r"]["label"], r["r"]["features"]) for r in parsed.collect()] == [
        (1, [(1, 5), (2, -1), (39, 4294967295)]), (0, []), (1, [(3, 2)]), (None, None)]
    plan = parsed.select(F.col("r.features"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(v") == 1


def test_logistic_input_is_not_kept_in_memory_twice():
    assert not learn.input_level("lr").useMemory and learn.input_level("rf").useMemory
