import hashlib
import math
import struct

from pyspark.sql import functions as F

from impressa.functions import encode, hashing, names
from impressa.schema import IMPRESSION


def _py_hash(token: str, m: int) -> int:
    return struct.unpack("<Q", hashlib.md5(token.encode()).digest()[:8])[0] % m


def _row(label=0, **kw):
    vals = {f.name: None for f in IMPRESSION.fields}
    vals["label"] = label
    vals.update(kw)
    return tuple(vals[f.name] for f in IMPRESSION.fields)


def test_all_null_features_give_bare_label(spark):
    df = spark.createDataFrame([_row(0)], IMPRESSION)
    line = df.select(encode.libsvm_line().alias("l")).first()[0]
    assert line == "0"
    idx = hashing.with_hashed_indices(df).select("indices").first()[0]
    assert idx == []


def test_log_square_bucket_boundaries(spark):
    df = spark.createDataFrame([(v,) for v in (2, 3, -1, 0, 20000, 10**12)], "v bigint")
    got = [r[0] for r in df.select(encode.log_square_bucket("v")).collect()]
    want = [v if v <= 2 else int(math.log(v) ** 2) for v in (2, 3, -1, 0, 20000, 10**12)]
    assert got == want == [2, 1, -1, 0, 98, 763]


def test_hex_parsing_edge_cases(spark):
    cases = ["0000abcd", "ffffffff", "0000ABCD", "zz", "12345678", "1234e567", None]
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    got = [r[0] for r in df.select(encode.hex_to_uint("c")).collect()]
    assert got == [43981, 4294967295, 43981, None, 305419896, 305456487, None]


def test_strict_hex_rejects_malformed(spark):
    import pytest

    df = spark.createDataFrame([("zz",)], "c string")
    with pytest.raises(Exception):
        df.select(encode.hex_to_uint("c", strict=True)).collect()


def test_hex_round_trip_keeps_leading_zeros(spark):
    df = spark.createDataFrame([("0000abcd",), ("0000ABCD",)], "c string")
    got = [r[0] for r in df.select(encode.uint_to_hex8(encode.hex_to_uint("c"))).collect()]
    assert got == ["0000abcd", "0000abcd"]


def test_hash_matches_python_reference_formula(spark):
    toks = ["1_6", "14_0000abcd", "39_ffffffff", "2_-1", "x", "ünï_çødé"]
    df = spark.createDataFrame([(t,) for t in toks], "t string")
    for m in (7, 30000, 100000, 2**31 - 1):
        got = [r[0] for r in df.select(hashing.hash_index("t", m)).collect()]
        assert got == [_py_hash(t, m) for t in toks]


def test_colliding_tokens_collapse_to_sorted_distinct(spark):
    row = _row(1, i1=5, i2=7, i3=9, c14="0000abcd", c15="00000001")
    df = spark.createDataFrame([row], IMPRESSION)
    idx = hashing.with_hashed_indices(df, 7).select("indices").first()[0]
    assert idx == sorted(set(idx))
    assert all(0 <= i < 7 for i in idx)


def test_libsvm_and_vw_lines(spark):
    row = _row(1, i1=5, i2=-1, c14="0000abcd", c39="ffffffff")
    df = spark.createDataFrame([row], IMPRESSION)
    line = df.select(encode.libsvm_line().alias("v")).first()[0]
    assert line == "1 1:5 2:-1 14:43981 39:4294967295"
    vw = df.select(encode.vw_line(encode.libsvm_line()).alias("v")).first()[0]
    assert vw == "1 | 1:5 2:-1 14_43981 39_4294967295"
    zero = spark.createDataFrame([("0",), ("0 3:2 14:1761707262",)], "value string")
    got = [r[0] for r in zero.select(encode.vw_line("value")).collect()]
    assert got == ["-1 |", "-1 | 3:2 14_1761707262"]


def test_parse_libsvm_round_trip(spark):
    df = spark.createDataFrame([("1 1:5 2:-1 14:43981",), ("0",)], "value string")
    rows = df.select(encode.parse_libsvm("value").alias("r")).collect()
    assert rows[0].r.label == 1 and [(p.idx, p.val) for p in rows[0].r.features] == [(1, 5), (2, -1), (14, 43981)]
    assert rows[1].r.label == 0 and rows[1].r.features == []


def test_sample_names(spark):
    sizes = [10000, 300000, 1000000, 3000000000]
    df = spark.createDataFrame([(n,) for n in sizes], "n bigint")
    got = [r[0] for r in df.select(names.size_to_name("n")).collect()]
    assert got == ["10k", "300k", "1kk", "3kkk"]
    back = spark.createDataFrame([(s,) for s in got + ["abc"]], "s string")
    assert [r[0] for r in back.select(names.name_to_size("s")).collect()] == sizes + [0]
    assert [names.py_size_to_name(n) for n in sizes] == got


def test_sample_names_shrink_every_group_of_zeros(spark):
    names_of = {10003000: "1k3k", 1000100: "1k100", 10000000: "10kk", 100: "100", 0: "0", 1000: "1k", 10010000: "10010k"}
    df = spark.createDataFrame([(n,) for n in names_of], "n bigint")
    got = {r["n"]: r["s"] for r in df.select("n", names.size_to_name("n").alias("s")).collect()}
    assert got == names_of == {n: names.py_size_to_name(n) for n in names_of}
    back = spark.createDataFrame([(s,) for s in names_of.values()], "s string")
    assert [r[0] for r in back.select(names.name_to_size("s")).collect()] == list(names_of)
    assert [names.py_name_to_size(s) for s in names_of.values()] == list(names_of)
    assert names.py_name_to_size("1k3k") == 10003000 and names.py_name_to_size("abc") == names.py_name_to_size("") == 0
