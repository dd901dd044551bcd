import hashlib

import pytest
from pyspark.sql import functions as F

from impressa.functions import encode
from impressa.plans import prepare
from impressa.schema import IMPRESSION
from impressa.session import staging_dir
from impressa.sources import impressions
from impressa.sources.lines import numbered_lines


def _rows():
    base = {f.name: None for f in IMPRESSION.fields}
    a = dict(base, label=1, i1=-4, c14="0000abcd", c39="1234e567")
    b = dict(base, label=0)  # all features null
    return [tuple(r[f.name] for f in IMPRESSION.fields) for r in (a, b)]


def test_raw_tsv_round_trip_keeps_text_and_nulls(spark):
    df = spark.createDataFrame(_rows(), IMPRESSION).withColumn("day", F.lit(3))
    root = staging_dir(spark, "raw")
    impressions.write_raw(df, root)
    back = impressions.read_raw(spark, f"{root}/day=*").orderBy(F.desc("label")).collect()
    assert back[0].c14 == "0000abcd" and back[0].c39 == "1234e567" and back[0].i1 == -4
    assert back[0].day == 3 and back[1].day == 3
    assert all(back[1][c] is None for c in IMPRESSION.fieldNames()[1:])


def test_index_hash_order_sorts_by_md5_of_input_position(spark):
    lines = [f"{i % 2} 1:{i}" for i in range(50)]
    path = staging_dir(spark, "lines")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    src = numbered_lines(spark, path)
    assert {r.value: r.line_no for r in src.collect()} == {x: i for i, x in enumerate(lines)}
    out = [r.value for r in prepare.index_hash_order(src).collect()]
    want = [lines[i] for i in sorted(range(50), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())]
    assert out == want


def test_write_lines_once_resumes(spark):
    src = staging_dir(spark, "chunks-in")
    for d in (0, 1):
        spark.createDataFrame([(f"{d} 1:{d}",)], "value string").write.text(f"{src}/day_{d}")
    dst = staging_dir(spark, "chunks-out")
    todo = {f"{dst}/day_{d}": lambda d=d: spark.read.text(f"{src}/day_{d}").select(encode.vw_line().alias("value"))
            for d in (0, 1)}
    first = prepare.write_lines_once(spark, todo)
    again = prepare.write_lines_once(spark, todo)
    assert first == list(todo) and again == []
    assert spark.read.text(dst + "/day_1").first()[0] == "1 | 1:1"


def test_read_metrics_quoted_and_plain(spark):
    import os

    path = staging_dir(spark, "metrics-files")
    os.makedirs(path)
    with open(os.path.join(path, "a.tsv"), "w") as f:
        f.write('"Engine"\t"Train size"\t"ROC AUC"\t"Log loss"\t"Train time"\n')
        f.write('"vw"\t10000\t0.617\t0.1445\t15.17\n')
    with open(os.path.join(path, "b.tsv"), "w") as f:
        f.write("Engine\tTrain size\tROC AUC\tLog loss\tTrain time\n")
        f.write("lr\t30000\t0.5938\t0.1814\t87.18\n")
    rows = sorted(impressions.read_metrics(spark, path).collect())
    assert [(r.engine, r.train_size, r.roc_auc) for r in rows] == [("lr", 30000, 0.5938), ("vw", 10000, 0.617)]
    assert rows[1].train_time == 15.17


def test_read_metrics_by_header_name_with_all_columns(spark):
    import os

    import pytest

    path = staging_dir(spark, "metrics-wide")
    os.makedirs(path)
    with open(os.path.join(path, "a.tsv"), "w") as f:
        f.write("Train size\tEngine\tMaximum memory\tCPU load\tLog loss\n10\tvw\t2048\t0.5\t0.25\n")
    row = impressions.read_metrics(spark, path).first()
    assert (row.engine, row.train_size, row.max_memory, row.cpu_load, row.log_loss, row.roc_auc) == ("vw", 10, 2048, 0.5, 0.25, None)
    with open(os.path.join(path, "a.tsv"), "a") as f:
        f.write("many\tvw\t1\t1\t1\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        impressions.read_metrics(spark, path).collect()


def test_text_conversion_rejects_null_labels_and_malformed_hex(spark):
    import pytest

    from impressa.functions import encode
    from impressa.schema import IMPRESSION

    empty = dict.fromkeys(IMPRESSION.names)
    for bad, told in (({"i1": 5}, "null label"), ({"label": 1, "c14": "xyz"}, "malformed hex")):
        df = spark.createDataFrame([tuple({**empty, **bad}.values())], IMPRESSION)
        with pytest.raises(Exception, match=told):
            df.select(encode.libsvm_line()).collect()


def test_convert_days_writes_pending_days_in_one_job(spark):
    df = spark.createDataFrame(_rows(), IMPRESSION).withColumn("day", F.col("label") + 3)
    raw, out = staging_dir(spark, "raw-days"), staging_dir(spark, "svm-days")
    impressions.write_raw(df, raw)
    assert prepare.convert_days(spark, raw, out, [3]) == [3]
    assert prepare.convert_days(spark, raw, out, [3, 4]) == [4]
    assert prepare.convert_days(spark, raw, out, [3, 4]) == []
    lines = {r.day: r.value for r in spark.read.text(out).collect()}
    assert lines[3].strip() == "0" and lines[4].startswith("1 1:")


def test_loaded_lines_plain_and_odd(spark):
    """plain lines are split once, without a lambda; odd ones keep the meaning that ``parse_libsvm`` gives them."""
    from impressa.functions import encode, hashing
    from impressa.schema import CATEGORICAL_COLS, FEATURE_INDEX, NUMERIC_COLS
    from impressa.sources import mldata

    texts = ["1 1:5 2:-3 14:255 39:4294967295", "0", "1 ", "0  3:7  15:16", "1 03:9 14:99999999999", "0 13:1 40:2"]
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    by_parse = df.select("value", encode.parse_libsvm("value").alias("r")).selectExpr("value", "r.label AS label", "map_from_entries(r.features) AS kv")
    cols = [f"element_at(kv, {FEATURE_INDEX[c]}) AS {c}" for c in NUMERIC_COLS]
    cols += [f"{encode.uint_to_hex8_sql(f'element_at(kv, {FEATURE_INDEX[c]})')} AS {c}" for c in CATEGORICAL_COLS]
    old = by_parse.selectExpr("label", *cols)
    assert sorted(map(str, mldata.impressions_from_lines(df).collect())) == sorted(map(str, old.collect()))
    want = hashing.with_hashed_indices(old, 1000).selectExpr("CAST(label AS DOUBLE) AS label", "indices")
    assert sorted(map(str, mldata.hashed_from_lines(df, 1000).collect())) == sorted(map(str, want.collect()))
    assert "str_to_map" in mldata.hashed_from_lines(df)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("line", ["1 5", "1 a:1", "1 2:x", "1 2:3 2:4"])
def test_malformed_lines_raise(spark, line):
    from impressa.sources import mldata

    with pytest.raises(Exception):
        mldata.impressions_from_lines(spark.createDataFrame([(line,)], "value string")).collect()
