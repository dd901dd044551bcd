"""Registered queries: one Spark plan and (where SQL can say it) one SQL twin each.

Names are ``<inventory id>_<slug>``.  Every query reads the given tables (the
impressions derive from ``events``) over their whole extent.  Doubles that
come out of a floating-point sum are rounded to 9 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impressa.functions import encode, hashing, names
from impressa.operators import linear, metrics, ordering, sampling
from impressa.plans import oracle as O
from impressa.schema import CATEGORICAL_COLS, DEFAULT_HASH_SPACE, FEATURE_COLS, NUMERIC_COLS
from impressa.sources.events import impressions_by_day, load_impressions
from impressa.sources.sinks import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

M = DEFAULT_HASH_SPACE
ALL_COLS = ["label"] + FEATURE_COLS


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def W(body: str, *ctes: str) -> str:
    """SQL with the adapter CTE (and more) in front."""
    return "WITH " + ",\n".join([O.adapter_cte(), *ctes]) + "\n" + body


def r9(c):
    return F.round(c, 9)


# ---------------------------------------------------------------- projections

@register("p1_libsvm_line", W("SELECT event_id, " + O.libsvm_line() + " AS line FROM imp"))
def p1_libsvm_line(spark, sf):
    return load_impressions(spark, sf).select("event_id", encode.libsvm_line().alias("line"))


@register("p3_hex_to_uint", W("SELECT event_id, " + ", ".join(
    f"{O.hex_to_uint(c)} AS x{c[1:]}" for c in CATEGORICAL_COLS) + " FROM imp"))
def p3_hex_to_uint(spark, sf):
    imp = load_impressions(spark, sf)
    return imp.select("event_id", *[encode.hex_to_uint(c).alias(f"x{c[1:]}") for c in CATEGORICAL_COLS])


_P4_VALS = ", ".join(NUMERIC_COLS + [O.hex_to_uint(c) for c in CATEGORICAL_COLS])


@register("p4_parse_libsvm", W(
    "SELECT event_id, label, CAST(idx AS INTEGER) AS idx, val FROM ("
    f"SELECT event_id, label, unnest(range(1, 40)) AS idx, unnest([{_P4_VALS}]) AS val FROM imp)"
    " WHERE val IS NOT NULL"))
def p4_parse_libsvm(spark, sf):
    imp = load_impressions(spark, sf)
    lines = imp.select("event_id", encode.libsvm_line().alias("value"))
    parsed = lines.select("event_id", encode.parse_libsvm("value").alias("r"))
    return parsed.select("event_id", F.col("r.label").alias("label"),
                         F.inline("r.features"))


def _vw_sql() -> str:
    head = "CASE WHEN label = 1 THEN '1 |' ELSE '-1 |' END"
    parts = [head]
    parts += [f"'{k}:' || CAST({c} AS VARCHAR)" for k, c in enumerate(NUMERIC_COLS, 1)]
    parts += [f"'{int(c[1:])}_' || CAST({O.hex_to_uint(c)} AS VARCHAR)" for c in CATEGORICAL_COLS]
    return "concat_ws(' ', " + ", ".join(parts) + ")"


@register("p5_libsvm_to_vw", W("SELECT event_id, " + _vw_sql() + " AS vw FROM imp"))
def p5_libsvm_to_vw(spark, sf):
    imp = load_impressions(spark, sf)
    return imp.select("event_id", encode.vw_line(encode.libsvm_line()).alias("vw"))


@register("p7_log_square_bucket", W("SELECT event_id, " + ", ".join(
    f"{O.log_square(c)} AS b{c[1:]}" for c in NUMERIC_COLS) + " FROM imp"))
def p7_log_square_bucket(spark, sf):
    imp = load_impressions(spark, sf)
    return imp.select("event_id", *[encode.log_square_bucket(c).alias(f"b{c[1:]}") for c in NUMERIC_COLS])


@register("p10_hash_index", W(
    f"SELECT event_id, CAST(feature AS INTEGER) AS feature, token, {O.hash_index('token', M)} AS idx "
    f"FROM (SELECT event_id, unnest(range(1, 40)) AS feature, unnest([{', '.join(O.tokens())}]) AS token "
    "FROM imp) WHERE token IS NOT NULL"))
def p10_hash_index(spark, sf):
    imp = load_impressions(spark, sf)
    t = imp.select("event_id", F.posexplode(hashing.feature_tokens()).alias("pos", "token"))
    return t.filter(F.col("token").isNotNull()).select(
        "event_id", (F.col("pos") + 1).cast("int").alias("feature"), "token",
        hashing.hash_index("token", M).alias("idx"))


@register("p11_hashed_indices", W(
    "SELECT event_id, CAST(len(l) AS INTEGER) AS n_idx, array_to_string(l, ',') AS indices "
    f"FROM (SELECT event_id, {O.hashed_indices(M)} AS l FROM imp)"))
def p11_hashed_indices(spark, sf):
    imp = load_impressions(spark, sf)
    idx = hashing.with_hashed_indices(imp.select("event_id", *ALL_COLS), M, out="l")
    return idx.select("event_id", F.size("l").cast("int").alias("n_idx"),
                      F.array_join("l", ",").alias("indices"))


def _name_sql(n: str) -> str:
    return f"reverse(replace(reverse(CAST({n} AS VARCHAR)), '000', 'k'))"


@register("p15_sample_names", W(
    "SELECT day, n_rows, name, COALESCE(TRY_CAST(replace(name, 'k', '000') AS BIGINT), 0) AS size "
    f"FROM (SELECT day, n_rows, {_name_sql('n_rows * 1000')} AS name FROM "
    "(SELECT day, count(*) AS n_rows FROM imp GROUP BY day))"))
def p15_sample_names(spark, sf):
    """Per-day row counts (times 1000, so names carry k) -> short names -> back."""
    per_day = load_impressions(spark, sf).groupBy("day").agg(F.count(F.lit(1)).alias("n_rows"))
    named = per_day.select("day", "n_rows", names.size_to_name(F.col("n_rows") * 1000).alias("name"))
    return named.withColumn("size", names.name_to_size("name"))


# ---------------------------------------------------------------- filters, counts

@register("f3_holdout_split", W(
    "SELECT split, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS positives, "
    "min(day) AS min_day, max(day) AS max_day FROM (SELECT *, CASE WHEN day = "
    "(SELECT max(day) FROM imp) THEN 'test' ELSE 'train' END AS split FROM imp) GROUP BY split"))
def f3_holdout_split(spark, sf):
    train, test = sampling.holdout_split(load_impressions(spark, sf))
    parts = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return parts.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("label").cast("bigint").alias("positives"),
        F.min("day").alias("min_day"), F.max("day").alias("max_day"))


@register("a1_row_count", W(
    "SELECT count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS positives, "
    "CAST(sum(label_click) AS BIGINT) AS clicks FROM imp"))
def a1_row_count(spark, sf):
    return load_impressions(spark, sf).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("label").cast("bigint").alias("positives"),
        F.sum("label_click").cast("bigint").alias("clicks"))


@register("a2_count_per_day", W("SELECT day, count(*) AS n_rows FROM imp GROUP BY ROLLUP (day)"))
def a2_count_per_day(spark, sf):
    return sampling.count_per_day(load_impressions(spark, sf))


# ---------------------------------------------------------------- global order

@register("w1_row_index", W(
    "SELECT event_id, row_number() OVER (ORDER BY i2, event_id) - 1 AS row_idx FROM imp"))
def w1_row_index(spark, sf):
    imp = load_impressions(spark, sf).select("event_id", F.col("i2").alias("user_id_k"))
    return ordering.global_index(imp, ["user_id_k", "event_id"], "row_idx") \
        .select("event_id", "row_idx")


@register("w2_prefix_sum", W(
    "SELECT event_id, CAST(sum(label_click) OVER (ORDER BY i2, event_id ROWS BETWEEN "
    "UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_clicks FROM imp"))
def w2_prefix_sum(spark, sf):
    imp = load_impressions(spark, sf).select(
        "event_id", F.col("i2").alias("user_id_k"), F.col("label_click").cast("bigint").alias("c"))
    out = ordering.prefix_sums(imp, ["user_id_k", "event_id"], {"cum_clicks": F.col("c")})
    return out.select("event_id", F.col("cum_clicks").cast("bigint").alias("cum_clicks"))


@register("o1_shuffle_order", W(
    "SELECT event_id, row_idx, row_number() OVER (ORDER BY md5(CAST(row_idx AS VARCHAR))) - 1 "
    "AS shuffle_pos FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS row_idx FROM imp)"))
def o1_shuffle_order(spark, sf):
    imp = load_impressions(spark, sf).select("event_id")
    idx = ordering.global_index(imp, ["event_id"], "row_idx")
    return ordering.shuffle_order(idx, "row_idx", "shuffle_pos")


TAKE_N = 1000


@register("o3_take_n", W(
    f"SELECT event_id FROM imp ORDER BY md5(CAST(event_id AS VARCHAR)), event_id LIMIT {TAKE_N}"))
def o3_take_n(spark, sf):
    imp = load_impressions(spark, sf).select("event_id")
    hashed = imp.withColumn("_h", ordering.md5_order_key("event_id"))
    return ordering.take_first(hashed, ["_h", "event_id"], TAKE_N).select("event_id")


# ---------------------------------------------------------------- sampling

R1_FRACTION = 0.1


@register("r1_bernoulli_sample", W(
    "SELECT event_id FROM imp WHERE CAST(('0x' || substr(" + O.sample_hash("event_id", "r1") +
    f", 1, 13)) AS UBIGINT) < {int(R1_FRACTION * sampling.PREFIX_RANGE)}"))
def r1_bernoulli_sample(spark, sf):
    imp = load_impressions(spark, sf).select("event_id")
    return sampling.bernoulli_sample(imp, "event_id", R1_FRACTION, salt="r1")


R2_N = 1000
R2_SALT = names.py_size_to_name(R2_N)


@register("r2_exact_sample", W(
    "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY " +
    O.sample_hash("event_id", R2_SALT) + f", event_id) AS rn FROM imp) WHERE rn <= {R2_N}"))
def r2_exact_sample(spark, sf):
    imp = load_impressions(spark, sf).select("event_id")
    return sampling.exact_sample(imp, "event_id", R2_N, salt=R2_SALT)


# ---------------------------------------------------------------- learning in SQL form

def hashed_rows(spark, sf, m=M):
    imp = load_impressions(spark, sf)
    return hashing.with_hashed_indices(imp, m).select("event_id", "day", "label", "indices")


def bayes_train_test(spark, sf, m=M):
    # encode once: the hashed rows are staged by day, so the split is partition pruning
    rows = stage(hashed_rows(spark, sf, m), "hashed-rows", partition_by="day")
    train, test = sampling.holdout_split(rows)
    model = linear.fit_bernoulli_bayes(train, m)
    return model, train, test


def _bayes_sql_ctes(m: int = M, train_filter: str = "day < (SELECT max(day) FROM hrows)") -> list[str]:
    """CTEs: hrows, train, n (class counts), w (idx, w, absent), consts, model scalars."""
    return [
        O.hashed_rows_cte(m),
        f"train AS (SELECT * FROM hrows WHERE {train_filter})",
        "n AS (SELECT CAST(sum(label) AS BIGINT) AS n1, CAST(count(*) - sum(label) AS BIGINT) AS n0 FROM train)",
        "cnt AS (SELECT idx, sum(label) AS c1, sum(1 - label) AS c0 FROM "
        "(SELECT label, unnest(indices) AS idx FROM train) GROUP BY idx)",
        "w AS (SELECT idx, "
        "CAST(round(((ln(c1 + 1.0) - ln(n1 + 2.0)) - (ln(n1 + 2.0 - c1 - 1.0) - ln(n1 + 2.0)) "
        "- (ln(c0 + 1.0) - ln(n0 + 2.0)) + (ln(n0 + 2.0 - c0 - 1.0) - ln(n0 + 2.0))) * 1e9) AS BIGINT) AS w, "
        "CAST(round(((ln(n1 + 2.0 - c1 - 1.0) - ln(n1 + 2.0)) - (ln(n0 + 2.0 - c0 - 1.0) - ln(n0 + 2.0))) * 1e9) "
        "AS BIGINT) AS absent FROM cnt, n)",
        "model AS (SELECT "
        "CAST(round(((ln(1.0) - ln(n1 + 2.0)) - (ln(n1 + 1.0) - ln(n1 + 2.0)) "
        "- (ln(1.0) - ln(n0 + 2.0)) + (ln(n0 + 1.0) - ln(n0 + 2.0))) * 1e9) AS BIGINT) AS default_w, "
        "CAST(round((ln(n1 + 1.0) - ln(n0 + 1.0)) * 1e9) AS BIGINT) "
        "+ (SELECT CAST(sum(absent) AS BIGINT) FROM w) "
        f"+ CAST(round(({m} - (SELECT count(*) FROM w)) * ((ln(n1 + 1.0) - ln(n1 + 2.0)) "
        "- (ln(n0 + 1.0) - ln(n0 + 2.0))) * 1e9) AS BIGINT) AS intercept FROM n)",
    ]


def _bayes_score_ctes(m: int = M, test_filter: str = "day = (SELECT max(day) FROM hrows)") -> list[str]:
    return _bayes_sql_ctes(m) + [
        f"test AS (SELECT * FROM hrows WHERE {test_filter})",
        "scored AS (SELECT t.event_id, t.label, CAST((SELECT intercept FROM model) + "
        "COALESCE(sum(CASE WHEN x.idx IS NULL THEN 0 ELSE COALESCE(w.w, (SELECT default_w FROM model)) END), 0) "
        "AS BIGINT) AS score FROM test t LEFT JOIN (SELECT event_id, unnest(indices) AS idx FROM test) x "
        "ON t.event_id = x.event_id LEFT JOIN w ON x.idx = w.idx GROUP BY t.event_id, t.label)",
        "pred AS (SELECT event_id, label, score, 1.0 / (1.0 + exp(-(CAST(score AS DOUBLE) / 1e9))) AS p FROM scored)",
    ]


@register("m5_bayes_weights", W("SELECT CAST(idx AS INTEGER) AS idx, w FROM w", *_bayes_sql_ctes()))
def m5_bayes_weights(spark, sf):
    model, _, _ = bayes_train_test(spark, sf)
    return model.weights


@register("m3_linear_score", W("SELECT event_id, label, score, round(p, 9) AS p FROM pred",
                               *_bayes_score_ctes()))
def m3_linear_score(spark, sf):
    model, _, test = bayes_train_test(spark, sf)
    scored = linear.linear_scores(test, model, key="event_id")
    return scored.select("event_id", "label", "score", r9(F.col("p")).alias("p"))


def _bayes_predictions(spark, sf):
    model, _, test = bayes_train_test(spark, sf)
    return linear.linear_scores(test, model, key="event_id")


_HIST = "hist AS (SELECT p AS score, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg FROM pred GROUP BY p)"
_METRICS = (
    "SELECT CAST(sum(pos) + sum(neg) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS positives, "
    "CAST(sum(2 * CAST(pos AS HUGEINT) * neg_below + CAST(pos AS HUGEINT) * neg) AS DOUBLE) / "
    "CAST(2 * CAST(sum(pos) AS HUGEINT) * sum(neg) AS DOUBLE) AS roc_auc, "
    "round(sum(pos * -ln(least(greatest(score, 1e-15), 1 - 1e-15)) + "
    "neg * -ln(1.0 - least(greatest(score, 1e-15), 1 - 1e-15))) / (sum(pos) + sum(neg)), 9) AS log_loss "
    "FROM (SELECT *, sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - neg "
    "AS neg_below FROM hist)")


@register("a8_evaluate", W(_METRICS, *_bayes_score_ctes(), _HIST))
def a8_evaluate(spark, sf):
    m = metrics.binary_metrics(_bayes_predictions(spark, sf), "label", "p")
    return m.select("n", "positives", "roc_auc", r9(F.col("log_loss")).alias("log_loss"))


@register("a6_auc_exact", W(
    "SELECT roc_auc FROM (" + _METRICS + ")", *_bayes_score_ctes(), _HIST))
def a6_auc_exact(spark, sf):
    return metrics.roc_auc(_bayes_predictions(spark, sf), "label", "p")


@register("a4_log_loss", W(
    "SELECT round(avg(CASE WHEN label = 1 THEN -ln(least(greatest(p, 1e-15), 1 - 1e-15)) "
    "ELSE -ln(1.0 - least(greatest(p, 1e-15), 1 - 1e-15)) END), 9) AS log_loss FROM pred",
    *_bayes_score_ctes()))
def a4_log_loss(spark, sf):
    ll = metrics.log_loss(_bayes_predictions(spark, sf), "label", "p")
    return ll.select(r9(F.col("log_loss")).alias("log_loss"))


@register("a5_roc_curve", W(
    "SELECT round(threshold, 9) AS threshold, tp, fp FROM ("
    "SELECT CAST('inf' AS DOUBLE) AS threshold, CAST(0 AS BIGINT) AS tp, CAST(0 AS BIGINT) AS fp "
    "UNION ALL SELECT score, CAST(sum(pos) OVER w AS BIGINT), CAST(sum(neg) OVER w AS BIGINT) FROM hist "
    "WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))",
    *_bayes_score_ctes(), _HIST))
def a5_roc_curve(spark, sf):
    roc = metrics.roc_curve(_bayes_predictions(spark, sf), "label", "p")
    return roc.select(r9(F.col("threshold")).alias("threshold"), "tp", "fp")


_PART_CTES = _bayes_score_ctes(test_filter="TRUE") + [
    "parts AS (SELECT CASE WHEN h.day = (SELECT max(day) FROM hrows) THEN 'test' ELSE 'train' END AS part, "
    "p.label, p.p FROM pred p JOIN hrows h ON p.event_id = h.event_id)",
    "hist AS (SELECT part, p AS score, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg "
    "FROM parts GROUP BY part, p)"]


def _bayes_parts(spark, sf):
    model, train, test = bayes_train_test(spark, sf)
    return {name: linear.linear_scores(df, model, key="event_id") for name, df in (("test", test), ("train", train))}


@register("a8_evaluate_parts", W(
    _METRICS.replace("SELECT CAST", "SELECT part, CAST", 1).replace("OVER (ORDER", "OVER (PARTITION BY part ORDER")
    + " GROUP BY part", *_PART_CTES))
def a8_evaluate_parts(spark, sf):
    """A8 with the train side (F4): exact AUC and log loss of the train days and of the last day."""
    m = metrics.by_part(_bayes_parts(spark, sf), metrics.binary_metrics)
    return m.select("part", "n", "positives", "roc_auc", r9(F.col("log_loss")).alias("log_loss"))


@register("a8_roc_parts", W(
    "SELECT part, round(score, 9) AS threshold, tp, fp, tp / max(tp) OVER (PARTITION BY part) AS tpr, "
    "fp / max(fp) OVER (PARTITION BY part) AS fpr FROM (SELECT part, score, CAST(sum(pos) OVER w AS BIGINT) AS tp, "
    "CAST(sum(neg) OVER w AS BIGINT) AS fp FROM hist WINDOW w AS (PARTITION BY part ORDER BY score DESC "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) UNION ALL SELECT DISTINCT part, CAST('inf' AS DOUBLE), "
    "CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM hist", *_PART_CTES))
def a8_roc_parts(spark, sf):
    """A8's ROC curves of both sides."""
    roc = metrics.by_part(_bayes_parts(spark, sf), metrics.roc_curve)
    return roc.select("part", r9(F.col("threshold")).alias("threshold"), "tp", "fp", "tpr", "fpr")


@register("j2_pair_labels_scores", W(
    "SELECT t.event_id, t.label, s.score FROM test t JOIN scored s ON t.event_id = s.event_id",
    *_bayes_score_ctes()))
def j2_pair_labels_scores(spark, sf):
    from impressa.operators.pairing import pair_by_key

    model, _, test = bayes_train_test(spark, sf)
    scores = linear.linear_scores(test, model, key="event_id", keep=()).select("event_id", "score")
    labels = test.select("event_id", "label")
    return pair_by_key(labels, scores, "event_id")


@register("m7_collision_rate", W(
    "SELECT m, n_tokens, n_indices, 1.0 - CAST(n_indices AS DOUBLE) / n_tokens AS collision_rate FROM ("
    "SELECT m, count(DISTINCT token) AS n_tokens, count(DISTINCT idx) AS n_indices FROM ("
    "SELECT token, 30000 AS m, " + O.hash_index("token", 30000) + " AS idx FROM toks UNION ALL "
    "SELECT token, 100000 AS m, " + O.hash_index("token", 100000) + " AS idx FROM toks) GROUP BY m)",
    "toks AS (SELECT DISTINCT token FROM (SELECT unnest([" + ", ".join(O.tokens()) + "]) AS token FROM imp) "
    "WHERE token IS NOT NULL)"))
def m7_collision_rate(spark, sf):
    """Share of distinct feature tokens lost to hash collisions, per hash-space size."""
    imp = load_impressions(spark, sf)
    toks = (imp.select(F.explode(hashing.feature_tokens()).alias("token"))
               .filter(F.col("token").isNotNull()).distinct())
    sizes = [30000, 100000]
    per_m = toks.select(F.explode(F.array(*[
        F.struct(F.lit(s).alias("m"), hashing.hash_index("token", s).alias("idx")) for s in sizes
    ])).alias("x"), "token").select("x.m", "x.idx", "token")
    agg = per_m.groupBy("m").agg(F.count_distinct("token").alias("n_tokens"),
                                 F.count_distinct("idx").alias("n_indices"))
    return agg.withColumn("collision_rate", 1.0 - F.col("n_indices") / F.col("n_tokens"))


@register("m9_cardinality", W(
    "SELECT feature, count(DISTINCT value) AS n_distinct FROM (UNPIVOT imp ON " +
    ", ".join(CATEGORICAL_COLS) + " INTO NAME feature VALUE value) GROUP BY feature"))
def m9_cardinality(spark, sf):
    """Exact distinct values per categorical column (why one-hot was rejected)."""
    imp = load_impressions(spark, sf)
    long = imp.unpivot([], CATEGORICAL_COLS, "feature", "value")
    return long.groupBy("feature").agg(F.count_distinct("value").alias("n_distinct"))


# ---------------------------------------------------------------- sources and sinks

def _raw_root(spark, sf) -> str:
    """Impressions written once in the raw TSV layout (day=N directories)."""
    from impressa.session import staging_dir
    from impressa.sources.impressions import write_raw

    root = staging_dir(spark, "raw-tsv")
    write_raw(load_impressions(spark, sf), root)
    return root


@register("s1_scan_tsv", W("SELECT " + ", ".join(ALL_COLS) + ", day FROM imp"))
def s1_scan_tsv(spark, sf):
    """Raw TSV written from the impressions, read back with the explicit schema."""
    from impressa.sources.impressions import read_raw

    root = _raw_root(spark, sf)
    return read_raw(spark, root).select(*ALL_COLS, "day")


@register("s3_scan_days", W(
    "SELECT day, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS positives FROM imp GROUP BY day"))
def s3_scan_days(spark, sf):
    """Many days as one dataset through a glob; day parsed from the path."""
    from impressa.sources.impressions import read_raw

    root = _raw_root(spark, sf)
    df = read_raw(spark, f"{root}/day=*")
    return df.groupBy("day").agg(F.count(F.lit(1)).alias("n_rows"),
                                 F.sum("label").cast("bigint").alias("positives"))


@register("u1_union_days", W(
    "SELECT day, count(*) AS n_rows FROM imp GROUP BY day"))
def u1_union_days(spark, sf):
    """Per-day datasets read one by one and unioned (the reference's union reduce)."""
    from impressa.sources.impressions import read_raw, union_days

    root = _raw_root(spark, sf)
    days = [r[0] for r in load_impressions(spark, sf).select("day").distinct().collect()]
    parts = [read_raw(spark, f"{root}/day={d}") for d in sorted(days)]
    return union_days(parts).groupBy("day").agg(F.count(F.lit(1)).alias("n_rows"))


@register("s2_scan_text", W("SELECT " + O.libsvm_line() + " AS value FROM imp"))
def s2_scan_text(spark, sf):
    """K1 + K5 + S2: LibSVM lines written as text, count verified, read back."""
    from impressa.session import staging_dir
    from impressa.sources import sinks
    from impressa.sources.impressions import read_lines

    imp = load_impressions(spark, sf)
    path = staging_dir(spark, "libsvm-text")
    sinks.write_text(imp.select(encode.libsvm_line().alias("value")), path)
    sinks.verify_count(spark, path, imp.count())
    return read_lines(spark, path)


@register("s6_label_score_files", W(
    "SELECT t.event_id, t.label, s.score FROM test t JOIN scored s ON t.event_id = s.event_id",
    *_bayes_score_ctes()))
def s6_label_score_files(spark, sf):
    """Label file and score file (``<row id> <value>`` lines) read and paired by row id."""
    from impressa.operators.pairing import pair_by_key
    from impressa.session import staging_dir
    from impressa.sources import sinks
    from impressa.sources.impressions import read_key_value_lines

    model, _, test = bayes_train_test(spark, sf)
    scores = linear.linear_scores(test, model, key="event_id", keep=())
    lp, sp = staging_dir(spark, "labels"), staging_dir(spark, "scores")
    sinks.write_text(test.select(F.concat_ws(" ", "event_id", "label").alias("value")), lp)
    sinks.write_text(scores.select(F.concat_ws(" ", "event_id", "score").alias("value")), sp)
    labels = read_key_value_lines(spark, lp, "event_id", "label", "int")
    sc = read_key_value_lines(spark, sp, "event_id", "score", "bigint")
    return pair_by_key(labels, sc, "event_id")


# ---------------------------------------------------------------- sample ladder

R3_SIZES = {"train": [1000, 3000, 10000, 30000], "test": [100, 1000]}

_SAMPLED = ("(VALUES " + ", ".join(f"({n}, '{names.py_size_to_name(n)}', '{part}')" for part, sizes in R3_SIZES.items() for n in sizes) +
            ") s(size, name, part) JOIN (SELECT *, CASE WHEN day < (SELECT max(day) FROM imp) THEN 'train' ELSE 'test' END "
            "AS part FROM imp) i ON i.part = s.part")
_IN_SAMPLE = ("QUALIFY row_number() OVER (PARTITION BY s.part, s.name ORDER BY "
              "md5(s.name || ':' || CAST(i.event_id AS VARCHAR)), i.event_id) <= s.size")


def _ladders(spark, imp, value, files):
    """F3 + R3: ladders of the train days and of the last day, as {(part, sample): path}."""
    from impressa.plans.prepare import write_ladder
    from impressa.session import staging_dir

    data = stage(imp.select("event_id", "day", value.alias("value")), "ladder-input")
    out = {}
    for part, df in zip(R3_SIZES, sampling.holdout_split(data)):
        root = staging_dir(spark, f"ladder-{part}")
        done = write_ladder(spark, df, R3_SIZES[part], root + "/{}", key="event_id", files=files)
        out |= {(part, name): f"{root}/{name}" for name, _ in done}
    return out


@register("r3_sample_ladder", W(
    "SELECT part, name AS sample, count(*) AS n_rows, CAST(sum(event_id) AS BIGINT) AS key_sum, "
    "min(event_id) AS key_min, max(event_id) AS key_max FROM (SELECT s.part, s.name, i.event_id FROM "
    + _SAMPLED + " " + _IN_SAMPLE + ") GROUP BY part, name"))
def r3_sample_ladder(spark, sf):
    """Exact samples of the train days and of the hold-out day written resumably as
    LibSVM text with the row id, verified by count, then summarised from the files."""
    from impressa.sources.impressions import read_key_value_lines, union_days

    line = F.concat_ws(" ", F.col("event_id").cast("string"), encode.libsvm_line())
    files = _ladders(spark, load_impressions(spark, sf), line, 4)
    parts = [read_key_value_lines(spark, path, "event_id", "label", "int")
             .withColumns({"part": F.lit(part), "sample": F.lit(name)}) for (part, name), path in files.items()]
    return union_days(parts).groupBy("part", "sample").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("event_id").cast("bigint").alias("key_sum"),
        F.min("event_id").alias("key_min"), F.max("event_id").alias("key_max"))


@register("k3_vw_samples", W(
    "SELECT s.part, s.name AS sample, " + _vw_sql() + " AS value FROM " + _SAMPLED + " " + _IN_SAMPLE))
def k3_vw_samples(spark, sf):
    """Samples written as LibSVM text, each converted resumably to VW lines in md5 order."""
    from impressa.plans.prepare import index_hash_order, write_lines_once
    from impressa.session import staging_dir
    from impressa.sources.impressions import read_lines, union_days
    from impressa.sources.lines import numbered_lines

    parts = []
    for (part, name), path in _ladders(spark, load_impressions(spark, sf), encode.libsvm_line(), 4).items():
        out = staging_dir(spark, f"vw-{part}")
        write_lines_once(spark, {f"{out}/{name}": lambda p=path: index_hash_order(
            numbered_lines(spark, p).select(encode.vw_line().alias("value"), "line_no"))})
        parts.append(read_lines(spark, f"{out}/{name}").select(F.lit(part).alias("part"), F.lit(name).alias("sample"), "value"))
    return union_days(parts)


# ---------------------------------------------------------------- sweeps and reports

def _sweep_sql(body: str) -> str:
    from impressa.plans.experiment import SWEEP_HASH_SPACES, SWEEP_LADDER

    ctes = O.bayes_sweep_ctes(SWEEP_LADDER, list(SWEEP_HASH_SPACES),
                              [names.py_size_to_name(n) for n in SWEEP_LADDER])
    ctes.append("sweep AS (SELECT CASE m WHEN 30000 THEN 'bayes-30k' ELSE 'bayes-100k' END AS engine, "
                "CAST(least(size, (SELECT n FROM ntrain)) AS BIGINT) AS train_size, roc_auc, log_loss FROM met)")
    return W(body, *ctes)


def _sweep(spark, sf):
    from impressa.plans.experiment import bayes_sweep

    return bayes_sweep(spark, sf)


@register("m6_learning_curve", _sweep_sql("SELECT * FROM sweep"))
def m6_learning_curve(spark, sf):
    """Learning curve x hash-space sweep (M6 + M7) of naive Bayes in SQL form."""
    return _sweep(spark, sf)


ENGINES = ["bayes-100k", "bayes-30k"]


@register("v1_pivot_metric", _sweep_sql(
    "SELECT train_size, max(CASE WHEN engine = 'bayes-100k' THEN log_loss END) AS \"bayes-100k\", "
    "max(CASE WHEN engine = 'bayes-30k' THEN log_loss END) AS \"bayes-30k\" FROM sweep GROUP BY train_size"))
def v1_pivot_metric(spark, sf):
    from impressa.operators import report

    return report.pivot_metric(_sweep(spark, sf), "log_loss", series_values=ENGINES)


@register("j1_outer_merge", _sweep_sql(
    "SELECT COALESCE(a.train_size, b.train_size) AS train_size, a.roc_auc AS \"bayes-100k\", "
    "b.roc_auc AS \"bayes-30k\" FROM (SELECT * FROM sweep WHERE engine = 'bayes-100k') a "
    "FULL OUTER JOIN (SELECT * FROM sweep WHERE engine = 'bayes-30k') b ON a.train_size = b.train_size"))
def j1_outer_merge(spark, sf):
    from impressa.operators import report

    return report.outer_merge(_sweep(spark, sf), "roc_auc", series_values=ENGINES)


@register("v2_best_engine", _sweep_sql(
    "SELECT engine, train_size, roc_auc, log_loss FROM sweep WHERE log_loss IS NOT NULL "
    "QUALIFY row_number() OVER (PARTITION BY train_size ORDER BY log_loss, engine) = 1"))
def v2_best_engine(spark, sf):
    from impressa.operators import report

    return report.best_per_size(_sweep(spark, sf), "log_loss", lower_is_better=True)


@register("v3_metric_ratio", _sweep_sql(
    "SELECT a.train_size, a.log_loss AS a_value, b.log_loss AS b_value, "
    "a.log_loss / b.log_loss AS ratio, (SELECT min(a2.train_size) FROM sweep a2 JOIN sweep b2 "
    "ON a2.train_size = b2.train_size WHERE a2.engine = 'bayes-30k' AND b2.engine = 'bayes-100k' "
    "AND a2.log_loss < b2.log_loss) AS a_better_from FROM sweep a JOIN sweep b "
    "ON a.train_size = b.train_size WHERE a.engine = 'bayes-30k' AND b.engine = 'bayes-100k'"))
def v3_metric_ratio(spark, sf):
    from impressa.operators import report

    return report.ratio_between(_sweep(spark, sf), "bayes-30k", "bayes-100k", "log_loss")


@register("v4_combine_tables", _sweep_sql(
    "SELECT engine, train_size, roc_auc, log_loss FROM sweep UNION ALL "
    "SELECT engine, train_size, roc_auc, log_loss FROM sweep WHERE engine = 'bayes-100k'"))
def v4_combine_tables(spark, sf):
    """Two result tables with different extra columns, combined on shared columns."""
    from impressa.operators import report

    sw = _sweep(spark, sf)
    a = sw.withColumn("hash_space", F.when(F.col("engine") == "bayes-30k", 30000).otherwise(100000))
    b = sw.filter(F.col("engine") == "bayes-100k").withColumn("test_day", F.lit(29))
    return report.combine_common([a, b])


@register("s7_scan_metrics", _sweep_sql(
    "SELECT engine, train_size, roc_auc, log_loss, CAST(NULL AS DOUBLE) AS train_time, "
    "train_size * 2 AS max_memory, CAST(0.5 AS DOUBLE) AS cpu_load FROM sweep"))
def s7_scan_metrics(spark, sf):
    """K6 + S7: metric rows appended as TSV (header per append), read back typed."""
    from impressa.session import staging_dir
    from impressa.sources import sinks
    from impressa.sources.impressions import read_metrics

    sw = _sweep(spark, sf).withColumns({"train_time": F.lit(None).cast("double"),
                                        "max_memory": F.col("train_size") * 2, "cpu_load": F.lit(0.5)})
    path = staging_dir(spark, "metrics-tsv")
    for eng in ENGINES:
        sinks.append_metrics(sw.filter(F.col("engine") == eng), path)
    return read_metrics(spark, path)


# ---------------------------------------------------------------- chunk conversion, VW

@register("k3_convert_days", W(
    "SELECT day, count(*) AS n_rows, CAST(sum(CAST(split_part(value, ' ', 1) AS INTEGER)) AS BIGINT) "
    "AS positives FROM (SELECT day, " + O.libsvm_line() + " AS value FROM imp) GROUP BY day"))
def k3_convert_days(spark, sf):
    """Raw TSV days -> LibSVM text per day, resumable; a second pass skips every day."""
    from impressa.plans.prepare import convert_days
    from impressa.session import staging_dir
    from impressa.sources.impressions import read_lines, read_raw

    raw = _raw_root(spark, sf)
    out = staging_dir(spark, "libsvm-days")
    days = sorted(r[0] for r in read_raw(spark, raw).select("day").distinct().collect())
    convert_days(spark, raw, out, days)
    if convert_days(spark, raw, out, days):
        raise RuntimeError("resumed conversion rewrote complete days")
    lines = read_lines(spark, out + "/day=*").withColumn(
        "day", F.regexp_extract(F.col("_metadata.file_path"), r"day=(\d+)", 1).cast("int"))
    return lines.groupBy("day").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.split_part("value", F.lit(" "), F.lit(1)).cast("int")).cast("bigint").alias("positives"))


def _day_files(spark, sf, value) -> str:
    """Text files of unequal size: one folder a day, a day's lines by event_id."""
    from impressa.session import staging_dir

    path = staging_dir(spark, "day-lines")
    impressions_by_day(spark, sf).select("day", value.alias("value")).write.partitionBy("day").text(path)
    return path


_DAY_ORDER = "row_number() OVER (ORDER BY 'day=' || day || '/', event_id) - 1"


@register("w1_file_order", W(
    "SELECT " + _DAY_ORDER + " AS line_no, " + O.libsvm_line() + " AS value FROM imp"))
def w1_file_order(spark, sf):
    """W1 on text: every line of many files of unequal size with its index in file order."""
    from impressa.sources.lines import numbered_lines

    return numbered_lines(spark, _day_files(spark, sf, encode.libsvm_line())).select("line_no", "value")


@register("o1_vw_shuffled_text", W(
    "SELECT row_number() OVER (ORDER BY md5(CAST(i AS VARCHAR))) - 1 AS line_no, value FROM (SELECT " + _DAY_ORDER
    + " AS i, " + _vw_sql() + " AS value FROM imp)"))
def o1_vw_shuffled_text(spark, sf):
    """LibSVM text -> VW lines in md5(file-order index) order, written, and read back in the order of their files."""
    from impressa.plans.prepare import index_hash_order
    from impressa.session import staging_dir
    from impressa.sources import sinks
    from impressa.sources.lines import numbered_lines

    src = numbered_lines(spark, _day_files(spark, sf, encode.libsvm_line()))
    dst = staging_dir(spark, "vw-shuffled")
    # converted after the sort, which reads its input twice
    sinks.write_text(index_hash_order(src).select(encode.vw_line().alias("value")), dst)
    return numbered_lines(spark, dst).select("line_no", "value")


@register("j2_pair_lines", W(
    "SELECT row_number() OVER (ORDER BY event_id) - 1 AS line_no, label, CAST(score AS DOUBLE) AS score FROM scored",
    *_bayes_score_ctes()))
def j2_pair_lines(spark, sf):
    """J2 by line position: a label file and a score file without ids, split into different numbers of files."""
    from impressa.session import staging_dir
    from impressa.sources import sinks
    from impressa.sources.lines import pair_files

    model, _, test = bayes_train_test(spark, sf)
    scored = stage(linear.linear_scores(test, model, key="event_id"), "line-scores")
    paths = [staging_dir(spark, "label-lines"), staging_dir(spark, "score-lines")]
    for path, cols, n in zip(paths, (("label", "p"), ("score",)), (3, 7)):
        lines = scored.repartitionByRange(n, "event_id").sortWithinPartitions("event_id")
        sinks.write_text(lines.select(F.concat_ws(" ", *cols).alias("value")), path)
    return pair_files(spark, *paths)


# ---------------------------------------------------------------- Spark ML (rows-only)

def _fit(kind, **over):
    def q(spark, sf):
        from impressa.plans.experiment import fit_and_evaluate

        return fit_and_evaluate(spark, sf, kind, over or None)
    return q


register("m1_logistic_regression")(_fit("lr"))
register("m2_random_forest")(_fit("rf"))
register("m4_boosted_trees")(_fit("gbt"))
register("m5_decision_tree")(_fit("tree"))
register("m5_naive_bayes")(_fit("bayes"))


@register("m6_lr_learning_curve")
def m6_lr_learning_curve(spark, sf):
    from impressa.plans.experiment import ml_sweep

    return ml_sweep(spark, sf, ["lr"], names.ladder(3, 9))


@register("m6_rf_learning_curve")
def m6_rf_learning_curve(spark, sf):
    from impressa.plans.experiment import ml_sweep

    return ml_sweep(spark, sf, ["rf"], names.ladder(3, 9))


@register("m7_lr_hash_sweep")
def m7_lr_hash_sweep(spark, sf):
    """Logistic regression over two hash spaces, at each train size of the ladder."""
    from impressa.plans.experiment import SWEEP_HASH_SPACES, ml_sweep

    return ml_sweep(spark, sf, ["lr"], names.ladder(3, 9), spaces=SWEEP_HASH_SPACES, series="{}-{}")


@register("m8_cross_validation")
def m8_cross_validation(spark, sf):
    from impressa.plans.experiment import cross_validate

    return cross_validate(spark, sf, "lr", {"regParam": (0.01, 0.03, 0.1)})


@register("m8_tree_cross_validation")
def m8_tree_cross_validation(spark, sf):
    """A grid of two parameters over decision trees."""
    from impressa.plans.experiment import cross_validate

    return cross_validate(spark, sf, "tree", {"maxDepth": (3, 5), "maxBins": (32, 64)}, folds=3)


@register("m10_parallelism_sweep")
def m10_parallelism_sweep(spark, sf):
    from impressa.plans.experiment import parallelism_sweep

    return parallelism_sweep(spark, sf)


M10_CORES = (1, 2, 4)


@register("m10_parallelism_sizes", W(
    "SELECT tasks, (SELECT count(*) FROM imp WHERE day < (SELECT max(day) FROM imp)) AS train_rows FROM (VALUES "
    + ", ".join(f"({p})" for p in M10_CORES) + ") v(tasks)"))
def m10_parallelism_sizes(spark, sf):
    """M10's columns that do not depend on the clock: tasks and rows of every fit."""
    from impressa.plans.experiment import parallelism_sweep

    return parallelism_sweep(spark, sf, M10_CORES).select("tasks", "train_rows")


@register("a7_evaluator_auc")
def a7_evaluator_auc(spark, sf):
    from impressa.plans.experiment import evaluator_agreement

    return evaluator_agreement(spark, sf)


@register("a7_evaluator_agrees", W(
    "SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, TRUE AS agrees FROM imp "
    "WHERE day = (SELECT max(day) FROM imp)"))
def a7_evaluator_agrees(spark, sf):
    """Spark ML's evaluator and the exact AUC give the same value for the naive Bayes scores of the last day."""
    pred = stage(_bayes_predictions(spark, sf).select("label", "p"), "a7-scores")
    theirs = metrics.evaluator_auc(pred, "label", "p")
    m = metrics.binary_metrics(pred, "label", "p")
    return m.select("n", "positives", (F.abs(F.col("roc_auc") - F.lit(theirs)) < 1e-9).alias("agrees"))


@register("s4_load_hashed", W(
    f"SELECT label, CAST(len(ix) AS INTEGER) AS nnz, array_to_string(ix, ',') AS indices FROM "
    f"(SELECT CAST(label AS DOUBLE) AS label, {O.hashed_indices(M)} AS ix FROM imp)"))
def s4_load_hashed(spark, sf):
    """Sample written as LibSVM text, loaded as a hashed-vector ML dataset."""
    from impressa.session import staging_dir
    from impressa.sources import mldata, sinks

    root = staging_dir(spark, "s4")
    imp = load_impressions(spark, sf)
    sinks.write_text(imp.select(encode.libsvm_line().alias("value")), root + "/10kk")
    df = mldata.load_ml_data(spark, root + "/{}", 10_000_000, partitions=8)
    # a sparse vector's text is (size,[indices],[values])
    indices = F.regexp_extract(F.col("features").cast("string"), r"\[([^\]]*)\]", 1)
    return df.select("label", F.size(F.filter(F.split(indices, ","), lambda x: x != "")).alias("nnz"),
                     indices.alias("indices"))


@register("s5_load_asis", W(
    "SELECT CAST(label AS DOUBLE) AS label, concat_ws(',', '0', " + ", ".join(
        f"CAST(COALESCE({c}, 0) AS BIGINT)" for c in NUMERIC_COLS + [O.hex_to_uint(c) for c in CATEGORICAL_COLS])
    + ") AS slots FROM imp"))
def s5_load_asis(spark, sf):
    """Sample written as LibSVM text, loaded as an as-is ML dataset."""
    from impressa.session import staging_dir
    from impressa.sources import mldata, sinks

    root = staging_dir(spark, "s5")
    imp = load_impressions(spark, sf)
    sinks.write_text(imp.select(encode.libsvm_line().alias("value")), root + "/10kk")
    df = mldata.load_ml_data_asis(spark, root + "/{}", 10_000_000, partitions=8)
    from pyspark.ml.functions import vector_to_array

    slots = F.transform(vector_to_array("features"), lambda v: v.cast("bigint").cast("string"))
    return df.select("label", F.concat_ws(",", slots).alias("slots"))


@register("p16_positive_probability")
def p16_positive_probability(spark, sf):
    """Test-day probabilities of class 1 from a fitted logistic regression."""
    from impressa.operators import learn
    from impressa.plans.experiment import ml_datasets

    train, test = ml_datasets(spark, sf, "lr")
    with learn.persisted(train.select("label", "features")) as cached:
        model = learn.make_classifier("lr").fit(cached)
    return learn.predictions(model, test, key="event_id")


@register("p16_bayes_probability", W("SELECT event_id, label, round(p, 4) AS p FROM pred", *_bayes_score_ctes()))
def p16_bayes_probability(spark, sf):
    """Test-day probabilities of class 1 out of the probability vectors of Spark ML's naive Bayes."""
    from impressa.operators import learn
    from impressa.plans.experiment import ml_datasets

    train, test = ml_datasets(spark, sf, "bayes", M)
    model = learn.make_classifier("bayes").fit(train.select("label", "features"))
    return learn.predictions(model, test, key="event_id").withColumn("p", F.round("p", 4))


# ---------------------------------------------------------------- streaming form of K3

@register("k3_stream_convert", W(
    "SELECT day, " + O.libsvm_line() + " AS value FROM imp"))
def k3_stream_convert(spark, sf):
    """Raw TSV files converted by an availableNow file stream; a second run finds
    nothing new (checkpointed), and the output is read back."""
    from impressa.session import staging_dir
    from impressa.streaming.convert import convert_stream

    raw = _raw_root(spark, sf)
    out, ckpt = staging_dir(spark, "stream-libsvm"), staging_dir(spark, "stream-ckpt")
    convert_stream(spark, raw + "/day=*", out, ckpt, max_files_per_trigger=8)
    convert_stream(spark, raw + "/day=*", out, ckpt)
    lines = spark.read.text(out + "/day=*")
    return lines.select(
        F.regexp_extract(F.col("_metadata.file_path"), r"day=(\d+)", 1).cast("int").alias("day"),
        "value")


@register("v2_best_overall", _sweep_sql(
    "SELECT engine, train_size, roc_auc, log_loss FROM sweep WHERE roc_auc IS NOT NULL "
    "ORDER BY roc_auc DESC, engine, train_size LIMIT 1"))
def v2_best_overall(spark, sf):
    """Single best cell of the sweep by AUC (a top-1 report)."""
    from impressa.operators import report

    return report.best_overall(_sweep(spark, sf), "roc_auc", lower_is_better=False)


@register("m9_one_hot_encoding", W(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST(count(DISTINCT {c}) AS INTEGER) AS n_labels, "
    f"CAST(count(DISTINCT {c}) + 1 AS INTEGER) AS category_size FROM imp WHERE day < (SELECT max(day) FROM imp)"
    for c in CATEGORICAL_COLS)))
def m9_one_hot_encoding(spark, sf):
    """One-hot encoding of the categoricals (the option the reference rejected for its
    width): per column, labels learned and one-hot vector size, on the train days."""
    from impressa.operators import onehot

    train, _ = sampling.holdout_split(load_impressions(spark, sf))
    return onehot.widths(onehot.dictionary(train, CATEGORICAL_COLS), CATEGORICAL_COLS)


_DICT = "train AS (SELECT * FROM imp WHERE day < (SELECT max(day) FROM imp)), dict AS (" + " UNION ALL ".join(
    f"SELECT {i} AS col, {c} AS value, row_number() OVER (ORDER BY count(*) DESC, {c}) - 1 AS label FROM train WHERE {c} IS NOT NULL GROUP BY {c}"
    for i, c in enumerate(CATEGORICAL_COLS)) + ")"


@register("m9_one_hot_rows", W(
    "SELECT event_id, string_agg(CAST(first + COALESCE(label, size) AS VARCHAR), ',' ORDER BY v.col) AS positions FROM "
    "(SELECT event_id, unnest(range(0, 26)) AS col, unnest([" + ", ".join(CATEGORICAL_COLS) + "]) AS value FROM imp) v "
    "JOIN places USING (col) LEFT JOIN dict ON dict.col = v.col AND dict.value = v.value GROUP BY event_id",
    _DICT,
    "places AS (SELECT col, size, sum(size + 1) OVER (ORDER BY col) - size - 1 AS first FROM (SELECT r.col, count(dict.col) AS size "
    "FROM (SELECT unnest(range(0, 26)) AS col) r LEFT JOIN dict ON dict.col = r.col GROUP BY r.col))"))
def m9_one_hot_rows(spark, sf):
    """One-hot positions of every impression, by a dictionary learned on the train days."""
    from impressa.operators import onehot

    imp = load_impressions(spark, sf)
    train, _ = sampling.holdout_split(imp)
    rows = onehot.encode(imp, onehot.dictionary(train, CATEGORICAL_COLS), CATEGORICAL_COLS, "event_id")
    return rows.select("event_id", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


R2_LARGE_N = 5000
R2_LARGE_SALT = names.py_size_to_name(R2_LARGE_N)


@register("r2_exact_sample_indexed", W(
    "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY " +
    O.sample_hash("event_id", R2_LARGE_SALT) + f", event_id) AS rn FROM imp) WHERE rn <= {R2_LARGE_N}"))
def r2_exact_sample_indexed(spark, sf):
    """R2 at half of the rows."""
    imp = load_impressions(spark, sf).select("event_id")
    return sampling.exact_sample(imp, "event_id", R2_LARGE_N, salt=R2_LARGE_SALT)


TAKE_LARGE_N = 7000


@register("o3_take_n_indexed", W(
    f"SELECT event_id FROM imp ORDER BY md5(CAST(event_id AS VARCHAR)), event_id LIMIT {TAKE_LARGE_N}"))
def o3_take_n_indexed(spark, sf):
    """O3 at most of the rows."""
    imp = load_impressions(spark, sf).select("event_id")
    hashed = imp.withColumn("_h", ordering.md5_order_key("event_id"))
    return ordering.take_first(hashed, ["_h", "event_id"], TAKE_LARGE_N).select("event_id")


# ---------------------------------------------------------------- boosted trees in SQL form

def _first_tree_params():
    from impressa.operators.boosting import BoostParams

    return BoostParams(rounds=1)


def _asis_values(spark, sf):
    """Impressions with every feature as a number, train days and last day."""
    imp = load_impressions(spark, sf)
    rows = imp.select("event_id", "day", "label", *NUMERIC_COLS, *[encode.hex_to_uint(c).alias(c) for c in CATEGORICAL_COLS])
    return sampling.holdout_split(stage(rows, "asis-values", partition_by="day"))


def _first_tree_sql(body: str) -> str:
    from impressa.operators.boosting import drawn_features

    p = _first_tree_params()
    return W(body, *O.boosted_tree_ctes(p, drawn_features(FEATURE_COLS, p.colsample, 0)))


@register("m4_first_tree", _first_tree_sql(
    "SELECT CAST(node AS INTEGER) AS node, depth, CAST(split.f AS INTEGER) AS feature, CAST(split.bin AS DOUBLE) AS threshold, split.ml = 1 AS null_left, "
    "node.g AS sum_g, node.h AS sum_h, node.n, weight FROM node LEFT JOIN split USING (node)"))
def m4_first_tree(spark, sf):
    """First boosted tree with the reference's settings: every node with its split, sums and regularised weight."""
    from impressa.operators import boosting

    train, _ = _asis_values(spark, sf)
    nodes = boosting.fit(train, FEATURE_COLS, _first_tree_params()).nodes(spark)
    return nodes.select("node", "depth", "feature", "threshold", "null_left", "sum_g", "sum_h", "n", F.col("value").cast("bigint").alias("weight"))


@register("m3_tree_score", _first_tree_sql(
    f"SELECT event_id, label, weight AS score, round(1.0 / (1.0 + exp(-(CAST(weight AS DOUBLE) / 1e9))), 9) AS p "
    f"FROM t{_first_tree_params().max_depth} JOIN node USING (node)"))
def m3_tree_score(spark, sf):
    """M3 for trees: the last day scored by a node table (the first boosted tree)."""
    from impressa.operators import boosting

    train, test = _asis_values(spark, sf)
    scored = boosting.score(test, boosting.fit(train, FEATURE_COLS, _first_tree_params()))
    return scored.select("event_id", "label", "score", r9(F.col("p")).alias("p"))


@register("m4_regularised_trees")
def m4_regularised_trees(spark, sf):
    """Boosted trees with the reference's depth, step, rounds, draws and penalties: exact metrics of the last day."""
    from impressa.operators import boosting

    train, test = _asis_values(spark, sf)
    params = boosting.BoostParams()
    model = boosting.fit(train, FEATURE_COLS, params)
    m = metrics.binary_metrics(boosting.score(test, model))
    return m.select(F.lit(params.rounds).alias("rounds"), "n", "positives", "roc_auc", "log_loss")


# ---------------------------------------------------------------- many models from one scan of counts

CV_ALPHAS, CV_FOLDS = (0.5, 1.0, 4.0), 5


def _log_odds(c1: str, c0: str, n1: str, n0: str, a: str) -> tuple[str, str]:
    """Fixed-point weight and absent term of an index, as in ``linear.fit_bernoulli_bayes``."""
    t1, t0 = f"(ln({c1} + {a}) - ln({n1} + 2 * {a}))", f"(ln({c0} + {a}) - ln({n0} + 2 * {a}))"
    v1, v0 = f"(ln({n1} + 2 * {a} - {c1} - {a}) - ln({n1} + 2 * {a}))", f"(ln({n0} + 2 * {a} - {c0} - {a}) - ln({n0} + 2 * {a}))"
    return f"CAST(round(({t1} - {v1} - {t0} + {v0}) * 1e9) AS BIGINT)", f"CAST(round(({v1} - {v0}) * 1e9) AS BIGINT)"


def _grouped_ctes(rows: str, models: str, uses: str) -> list[str]:
    """``w``, ``model``: weights and intercepts of naive Bayes models.

    ``rows``: (event_id, label, indices, g); ``models``: (k, a); model k learns from the groups g for which ``uses`` holds.
    """
    w, absent = _log_odds("c1", "c0", "n1", "n0", "a")
    return [
        f"grows AS MATERIALIZED ({rows})", f"models AS ({models})",
        f"cls AS (SELECT k, a, CAST(sum(label) AS DOUBLE) AS n1, CAST(sum(1 - label) AS DOUBLE) AS n0 FROM models JOIN grows ON {uses} GROUP BY k, a)",
        "gcnt AS (SELECT g, idx, sum(label) AS c1, sum(1 - label) AS c0 FROM (SELECT g, label, unnest(indices) AS idx FROM grows) GROUP BY g, idx)",
        f"mcnt AS (SELECT k, a, i.idx, COALESCE(sum(c1) FILTER (WHERE {uses}), 0)::DOUBLE AS c1, COALESCE(sum(c0) FILTER (WHERE {uses}), 0)::DOUBLE AS c0 "
        "FROM models CROSS JOIN (SELECT DISTINCT idx FROM gcnt) i JOIN gcnt ON gcnt.idx = i.idx GROUP BY k, a, i.idx)",
        f"w AS MATERIALIZED (SELECT k, a, idx, {w} AS w, {absent} AS absent FROM mcnt JOIN cls USING (k, a))",
        f"model AS (SELECT cls.k, cls.a, CAST(round((ln(n1 + a) - ln(n0 + a)) * 1e9) AS BIGINT) + s.absent + CAST(round(({M} - s.n) * "
        "((ln(n1 + a) - ln(n1 + 2 * a)) - (ln(n0 + a) - ln(n0 + 2 * a))) * 1e9) AS BIGINT) AS intercept, "
        "CAST(round(((ln(a) - ln(n1 + 2 * a)) - (ln(n1 + a) - ln(n1 + 2 * a)) - (ln(a) - ln(n0 + 2 * a)) + (ln(n0 + a) - ln(n0 + 2 * a))) * 1e9) AS BIGINT) AS unseen "
        "FROM cls JOIN (SELECT k, a, count(*) AS n, CAST(sum(absent) AS BIGINT) AS absent FROM w GROUP BY k, a) s USING (k, a))",
    ]


def _grouped_scores(rows: str, on: str) -> list[str]:
    """``pred(k, a, event_id, label, p)``: rows of ``rows`` scored by the models for which ``on`` holds."""
    return [
        f"trows AS MATERIALIZED ({rows})",
        "tix AS (SELECT event_id, unnest(indices) AS idx FROM trows)",
        f"pred AS (SELECT k, a, event_id, label, 1.0 / (1.0 + exp(-(CAST(score AS DOUBLE) / 1e9))) AS p FROM (SELECT mo.k, mo.a, t.event_id, t.label, "
        f"mo.intercept + COALESCE(CAST(sum(CASE WHEN x.idx IS NULL THEN 0 ELSE COALESCE(w.w, mo.unseen) END) AS BIGINT), 0) AS score FROM model mo JOIN trows t ON {on} "
        "LEFT JOIN tix x ON x.event_id = t.event_id LEFT JOIN w ON w.k = mo.k AND w.a = mo.a AND w.idx = x.idx "
        "GROUP BY mo.k, mo.a, mo.intercept, t.event_id, t.label))",
    ]


_LAST_DAY = "(SELECT max(day) FROM hrows)"
_FOLD = f"CAST(CAST(('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8)) AS UBIGINT) % {CV_FOLDS} AS INTEGER)"
_FOLD_ROWS = f"SELECT event_id, label, indices, {_FOLD} AS g FROM hrows WHERE day < {_LAST_DAY}"


@register("m8_bayes_cross_validation", W(
    "SELECT a AS alpha, CAST(k AS INTEGER) AS fold, count(*) AS n_rows, round(avg(CASE WHEN label = 1 THEN -ln(least(greatest(p, 1e-15), 1 - 1e-15)) "
    "ELSE -ln(1.0 - least(greatest(p, 1e-15), 1 - 1e-15)) END), 9) AS log_loss FROM pred GROUP BY a, k",
    O.hashed_rows_cte(M),
    *_grouped_ctes(_FOLD_ROWS, f"SELECT k, a FROM (SELECT unnest(range(0, {CV_FOLDS})) AS k) CROSS JOIN (VALUES "
                   + ", ".join(f"({a}::DOUBLE)" for a in CV_ALPHAS) + ") v(a)", "g <> k"),
    *_grouped_scores("SELECT * FROM grows", "t.g = mo.k")))
def m8_bayes_cross_validation(spark, sf):
    """M8 with folds by key hash: every (smoothing, fold) cell of naive Bayes, all from one aggregate of counts."""
    from impressa.plans.experiment import bayes_cross_validation

    out = bayes_cross_validation(spark, sf, CV_ALPHAS, CV_FOLDS, M)
    return out.select("alpha", "fold", "n_rows", r9(F.col("log_loss")).alias("log_loss"))


def _nested_ladder():
    from impressa.plans.experiment import SWEEP_LADDER

    return ", ".join(f"({n})" for n in SWEEP_LADDER)


_NESTED = [
    O.hashed_rows_cte(M),
    f"ranked AS (SELECT *, row_number() OVER (ORDER BY {O.sample_hash('event_id', 'nested')}, event_id) AS rn FROM hrows WHERE day < {_LAST_DAY})",
    f"total AS (SELECT count(*) AS n FROM ranked)",
    f"rungs AS (SELECT size, row_number() OVER (ORDER BY size) - 1 AS k FROM (VALUES {_nested_ladder()}) v(size), total "
    f"WHERE size <= n OR size = (SELECT min(size) FROM (VALUES {_nested_ladder()}) v(size) WHERE size >= n))",
    *_grouped_ctes("SELECT event_id, label, indices, (SELECT min(k) FROM rungs WHERE size >= rn) AS g FROM ranked", "SELECT k, 1.0::DOUBLE AS a FROM rungs", "g <= k"),
    *_grouped_scores(f"SELECT * FROM hrows WHERE day = {_LAST_DAY}", "TRUE"),
    "hist AS (SELECT k, p AS score, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg FROM pred GROUP BY k, p)"]


@register("m6_nested_curve", W(
    "SELECT least(size, (SELECT n FROM total)) AS train_size, roc_auc, log_loss FROM rungs JOIN ("
    + _METRICS.replace("SELECT CAST", "SELECT k, CAST", 1).replace("OVER (ORDER", "OVER (PARTITION BY k ORDER") + " GROUP BY k) USING (k)", *_NESTED))
def m6_nested_curve(spark, sf):
    """M6 from one scan: nested samples of the ladder, every rung's naive Bayes model from cumulated counts."""
    from impressa.plans.experiment import nested_curve

    return nested_curve(spark, sf, m=M)


# ---------------------------------------------------------------- fast hash

@register("p10_fast_indices", W(
    "SELECT event_id, CAST(len(l) AS INTEGER) AS n_idx, array_to_string(l, ',') AS indices FROM (SELECT event_id, "
    "list_sort(list_distinct(list_filter([" + ", ".join(
        O.fast_index(k, O.log_square(c) if c in NUMERIC_COLS else O.hex_to_uint(c), M) for k, c in enumerate(FEATURE_COLS, 1))
    + "], lambda x: x IS NOT NULL))) AS l FROM imp)"))
def p10_fast_indices(spark, sf):
    """Fast mode of P10 over all rows: integer hashing of (feature, value) without text or MD5."""
    imp = load_impressions(spark, sf).select("event_id", *ALL_COLS)
    idx = hashing.with_fast_indices(imp, M, out="l")
    return idx.select("event_id", F.size("l").cast("int").alias("n_idx"), F.array_join("l", ",").alias("indices"))


# ---------------------------------------------------------------- reports over click rates by day and feature value

_RATE_DAYS = [f"d{d}" for d in range(30)]


def _rates_cte(name: str, columns: list[str]) -> str:
    return (f"{name} AS (SELECT feature || '=' || v AS value, 'd' || day AS day, count(*) AS n, CAST(sum(label_click) AS BIGINT) AS clicks, "
            f"CAST(sum(label_click) AS DOUBLE) / count(*) AS click_rate FROM (UNPIVOT (SELECT day, label_click, " + ", ".join(columns)
            + " FROM imp) ON " + ", ".join(columns) + " INTO NAME feature VALUE v) GROUP BY ALL)")


_RATES = _rates_cte("rates", CATEGORICAL_COLS)


def _rates(spark, sf, columns=CATEGORICAL_COLS):
    from impressa.plans.experiment import click_rates

    return stage(click_rates(load_impressions(spark, sf), columns), "click-rates")


def _rate_columns(metric: str) -> str:
    return ", ".join(f"max(CASE WHEN day = '{d}' THEN {metric} END) AS {d}" for d in _RATE_DAYS)


@register("v1_rate_pivot", W(f"SELECT value, {_rate_columns('click_rate')} FROM rates GROUP BY value", _RATES))
def v1_rate_pivot(spark, sf):
    """V1 over thousands of feature values: click rate, one column a day; the days are found (A3)."""
    from impressa.operators import report

    return report.pivot_metric(_rates(spark, sf), "click_rate", x="value", series="day")


@register("j1_rate_merge", W(f"SELECT value, {_rate_columns('clicks')} FROM rates GROUP BY value", _RATES))
def j1_rate_merge(spark, sf):
    """J1 over thousands of feature values: clicks of all days, outer-merged; the days are found (A3)."""
    from impressa.operators import report

    return report.outer_merge(_rates(spark, sf), "clicks", x="value", series="day")


@register("v2_rate_best_day", W(
    "SELECT * FROM rates QUALIFY row_number() OVER (PARTITION BY value ORDER BY click_rate DESC, day) = 1", _RATES))
def v2_rate_best_day(spark, sf):
    """V2 over thousands of feature values: the day of the highest click rate."""
    from impressa.operators import report

    return report.best_per_size(_rates(spark, sf), "click_rate", lower_is_better=False, x="value", series="day")


@register("v3_rate_ratio", W(
    "SELECT a.value, a.click_rate AS a_value, b.click_rate AS b_value, CASE WHEN b.click_rate <> 0 THEN a.click_rate / b.click_rate END AS ratio, "
    "(SELECT min(x.value) FROM rates x JOIN rates y ON x.value = y.value WHERE x.day = 'd1' AND y.day = 'd2' AND x.click_rate < y.click_rate) AS a_better_from "
    "FROM rates a JOIN rates b ON a.value = b.value WHERE a.day = 'd1' AND b.day = 'd2'", _RATES))
def v3_rate_ratio(spark, sf):
    """V3 over thousands of feature values: click rate of one day against another's."""
    from impressa.operators import report

    return report.ratio_between(_rates(spark, sf), "d1", "d2", "click_rate", x="value", series="day")


@register("v4_rate_combine", W("SELECT value, day, n, clicks, click_rate FROM rates UNION ALL SELECT value, day, n, clicks, click_rate FROM wide",
                               _RATES, _rates_cte("wide", NUMERIC_COLS)))
def v4_rate_combine(spark, sf):
    """V4 over thousands of groups: rates of categorical and of numeric values, tables with different extra columns."""
    from impressa.operators import report

    a = _rates(spark, sf).withColumn("kind", F.lit("categorical"))
    b = _rates(spark, sf, NUMERIC_COLS).withColumn("source_columns", F.lit(len(NUMERIC_COLS)))
    return report.combine_common([a, b])


# ---------------------------------------------------------------- logistic regression in SQL form

STEP = 4.0


@register("m1_logistic_step", W(
    "SELECT CAST(idx AS INTEGER) AS idx, w, CAST(sum(g) AS BIGINT) AS g FROM (SELECT x.idx, w1.w, CAST(round((s.p - s.label) * 1e9) AS BIGINT) AS g FROM "
    "(SELECT event_id, label, 1.0 / (1.0 + exp(-(CAST(sum(w) AS DOUBLE) / 1e9))) AS p FROM ix JOIN w1 USING (idx) GROUP BY event_id, label) s "
    "JOIN ix x ON x.event_id = s.event_id JOIN w1 ON w1.idx = x.idx) GROUP BY idx, w",
    O.hashed_rows_cte(M),
    f"ix AS MATERIALIZED (SELECT event_id, label, unnest(list_prepend(-1, indices)) AS idx FROM hrows WHERE day < {_LAST_DAY})",
    "g0 AS (SELECT idx, sum(CASE WHEN label = 1 THEN -500000000 ELSE 500000000 END) AS g FROM ix GROUP BY idx)",
    f"w1 AS MATERIALIZED (SELECT idx, CAST(round(-(CAST(g AS DOUBLE) * {STEP}::DOUBLE / (SELECT count(DISTINCT event_id) FROM ix))) AS BIGINT) AS w FROM g0)"))
def m1_logistic_step(spark, sf):
    """M1, checked form: the weights after one full gradient step from zero, and the gradient there (idx -1: intercept)."""
    from impressa.operators import logistic

    train, _ = hashed_split_of(spark, sf)
    n = train.count()
    zero = linear.LinearModel(spark.createDataFrame([], "idx int, w bigint"), 0, 0, M)
    first = stage(logistic.gradient(train, zero).select("idx", F.round(-(F.col("g").cast("double") * STEP / n)).cast("bigint").alias("w")), "lr-step")
    intercept = first.where(F.col("idx") == logistic.INTERCEPT).first()["w"]
    then = linear.LinearModel(first.where(F.col("idx") != logistic.INTERCEPT), intercept, 0, M)
    return first.join(logistic.gradient(train, then).select("idx", "g"), "idx")


@register("m1_logistic_fixed_point")
def m1_logistic_fixed_point(spark, sf):
    """M1 by fixed-point gradients with the reference's L2 of 0.03, fitted on the train days: exact metrics of the last day."""
    from impressa.operators import learn, logistic

    train, test = hashed_split_of(spark, sf)
    got = logistic.fit(train, M, reg=learn.LR_PARAMS["regParam"], tol=1e-4)
    m = metrics.binary_metrics(linear.linear_scores(test, got.model(spark), key="event_id"))
    return m.select(F.lit(got.iterations).alias("iterations"), "n", "positives", "roc_auc", "log_loss")


def hashed_split_of(spark, sf):
    from impressa.plans.experiment import hashed_split

    return hashed_split(spark, sf, M)


# ---------------------------------------------------------------- bounded ROC curve

ROC_POINTS = 64

_BUCKETS = [
    "cut AS (SELECT list(DISTINCT p) AS cl FROM (SELECT p, row_number() OVER (ORDER BY p) AS rn, count(*) OVER () AS n FROM pred) "
    f"JOIN (SELECT unnest(range(1, {ROC_POINTS})) AS k) ON rn = CAST(ceil(k * n / {ROC_POINTS}.0) AS BIGINT))",
    "bucket AS (SELECT len(list_filter(cl, lambda c: c <= p)) + len(list_filter(cl, lambda c: c < p)) AS b, min(p) AS low, max(p) AS high, CAST(sum(label) AS BIGINT) AS pos, "
    "CAST(sum(1 - label) AS BIGINT) AS neg FROM pred, cut GROUP BY ALL)"]


@register("a5_roc_sketch", W(
    "SELECT round(low, 9) AS threshold, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp FROM bucket "
    "WINDOW w AS (ORDER BY b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) UNION ALL SELECT CAST('inf' AS DOUBLE), 0, 0",
    *_bayes_score_ctes(), *_BUCKETS))
def a5_roc_sketch(spark, sf):
    """A5 with at most 128 points: counts at quantiles of the scores, found by mergeable sketches."""
    roc = metrics.roc_sketch(_bayes_predictions(spark, sf), points=ROC_POINTS)
    return roc.select(r9(F.col("threshold")).alias("threshold"), "tp", "fp")


@register("a5_auc_bounds", W(
    "SELECT CAST(sum(sure) AS DOUBLE) / CAST(2 * sum(pos) * sum(neg) AS DOUBLE) AS auc_low, CAST(sum(sure) + sum(inside) AS DOUBLE) / "
    "CAST(2 * sum(pos) * sum(neg) AS DOUBLE) AS auc_high FROM (SELECT pos::HUGEINT AS pos, neg::HUGEINT AS neg, 2 * pos * COALESCE(sum(neg) OVER "
    "(ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN low = high THEN pos * neg ELSE 0 END AS sure, "
    "CASE WHEN low < high THEN 2 * pos * neg ELSE 0 END AS inside FROM bucket)", *_bayes_score_ctes(), *_BUCKETS))
def a5_auc_bounds(spark, sf):
    """Bounds of the exact AUC from the bounded curve's counts."""
    return metrics.auc_bounds(_bayes_predictions(spark, sf), points=ROC_POINTS)
