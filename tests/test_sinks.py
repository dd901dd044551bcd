import os

from impressa.session import staging_dir
from impressa.sources import sinks


def test_write_once_skips_complete_and_replaces_partial(spark):
    path = staging_dir(spark, "resume")
    calls = []

    def build():
        calls.append(1)
        return spark.range(5).selectExpr("CAST(id AS STRING) AS value")

    def write(df, p):
        sinks.write_text(df, p)

    os.makedirs(path)
    open(os.path.join(path, "part-junk"), "w").write("partial\n")
    assert sinks.write_once(spark, path, build, write) is True
    assert spark.read.text(path).count() == 5
    assert sinks.write_once(spark, path, build, write) is False
    assert len(calls) == 1
    assert sinks.verify_count(spark, path, 5) == 5


def test_verify_count_raises(spark):
    import pytest

    path = staging_dir(spark, "count")
    sinks.write_text(spark.range(3).selectExpr("CAST(id AS STRING) AS value"), path)
    with pytest.raises(sinks.CountMismatch):
        sinks.verify_count(spark, path, 4)


def test_persisted_scope(spark):
    from impressa.operators.learn import persisted

    df = spark.range(10)
    with persisted(df) as d:
        assert d.is_cached and d.count() == 10
    assert not df.is_cached


def test_clear_staging(spark):
    path = staging_dir(spark, "gone")
    sinks.write_text(spark.range(3).selectExpr("CAST(id AS STRING) AS value"), path)
    assert sinks.is_complete(spark, path)
    sinks.clear_staging(spark)
    assert not sinks.path_exists(spark, path)
