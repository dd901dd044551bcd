"""Spark queries against their SQL twins on the smallest data set."""

import pytest

from oracle_harness import compare

FAST = ["a1_row_count", "a2_count_per_day", "p1_libsvm_line", "p3_hex_to_uint", "p4_parse_libsvm",
        "p5_libsvm_to_vw", "p7_log_square_bucket", "p10_hash_index", "p11_hashed_indices",
        "p15_sample_names", "f3_holdout_split", "w1_row_index", "w2_prefix_sum", "o1_shuffle_order",
        "o3_take_n", "r1_bernoulli_sample", "r2_exact_sample", "m7_collision_rate", "m9_cardinality",
        "a8_evaluate", "a5_roc_curve", "m5_bayes_weights", "s1_scan_tsv", "s2_scan_text",
        "r3_sample_ladder", "v1_pivot_metric", "v3_metric_ratio", "w1_file_order", "j2_pair_lines",
        "p10_fast_indices", "m4_first_tree", "v1_rate_pivot", "m9_one_hot_rows"]


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, name):
    res = compare(spark, "/root/testdata/sf0.001", [name], verbose=False)
    assert res[name].startswith("ok"), res[name]


def test_entry_runs(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() == 1
    assert df.columns == ["n", "positives", "roc_auc", "log_loss"]
