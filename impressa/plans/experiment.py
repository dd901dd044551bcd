"""Entry B: learning-curve, hash-space, model-class, CV and parallelism sweeps.

A sweep is a driver loop over (classifier, train size) cells; each cell is
distributed work (sample, fit, score, exact metrics) and yields one metric
row.  The loop's state is a handful of scalars per cell.

``bayes_sweep`` is fully deterministic (fixed-point naive Bayes in SQL form),
so its metric table has an SQL twin; the Spark ML sweeps record wall-clock
train times and are checked on row counts only.
"""

from __future__ import annotations

import time
from collections.abc import Iterable
from functools import reduce

from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impressa.functions import hashing
from impressa.functions.names import ladder, py_size_to_name
from impressa.operators import grouped, learn, linear, metrics, ordering, sampling
from impressa.sources import mldata
from impressa.sources.events import load_impressions, tasks_for
from impressa.sources.sinks import stage

SWEEP_LADDER = ladder(2, 9)     # 100 .. 3e9, as the reference's 10^k, 3*10^k
SWEEP_HASH_SPACES = (30_000, 100_000)


def sizes_upto(sizes: Iterable[int], total: int) -> list[int]:
    """Ladder sizes up to and including the first one that covers all rows."""
    out = []
    for n in sorted(sizes):
        out.append(n)
        if n >= total:
            break
    return out


def hashed_split(spark: SparkSession, sf_dir: str, m: int) -> tuple[DataFrame, DataFrame]:
    imp = load_impressions(spark, sf_dir)
    rows = stage(hashing.with_hashed_indices(imp, m).select("event_id", "day", "label", "indices"),
                 f"hashed-{m}", partition_by="day")
    return sampling.holdout_split(rows)


def bayes_sweep(spark: SparkSession, sf_dir: str, sizes: Iterable[int] = SWEEP_LADDER,
                hash_spaces: Iterable[int] = SWEEP_HASH_SPACES) -> DataFrame:
    """M6 + M7 (SQL form): (engine, train_size, roc_auc, log_loss) per hash space x size.

    The impressions are hashed once for all spaces, the samples are conditions
    on the staged rows, and one scan a hash space counts for all sizes.
    """
    spaces = {f"indices_{m}": int(m) for m in hash_spaces}
    coded = hashing.with_hash_spaces(load_impressions(spark, sf_dir), spaces).select("event_id", "day", "label", *spaces)
    rows = stage(coded.withColumn("_row", F.monotonically_increasing_id()), "hashed-spaces", partition_by="day")
    train, test = sampling.holdout_split(rows)
    total = train.count()
    ladder_sizes = sizes_upto(sizes, total)
    members = sampling.sample_members(train, "event_id", {py_size_to_name(n): n for n in ladder_sizes}, "_row", total)
    out = []
    for column, m in spaces.items():
        counts, n1, n0 = grouped.member_counts(train, list(members.values()), indices=column)
        models = grouped.fit_from_counts(counts, n1, n0, [[k] for k in range(len(ladder_sizes))], m, [1.0], seen_only=True)
        scored = grouped.scores(test.select("event_id", "label", column), models, list(range(len(models))), column)
        met = metrics.many_metrics(scored, {str(min(int(n), total)): linear.sigmoid_fixed(F.col(f"score_{k}")) for k, n in enumerate(ladder_sizes)})
        out.append(met.select(F.lit(f"bayes-{py_size_to_name(m)}").alias("engine"), F.col("part").cast("bigint").alias("train_size"),
                              "roc_auc", F.round("log_loss", 9).alias("log_loss")))
    return stage(reduce(DataFrame.unionByName, out), "bayes-sweep", files=1)


def ml_datasets(spark: SparkSession, sf_dir: str, kind: str, m: int = 100_000):
    """(train, test) ML datasets: hashed vectors for linear/bayes, as-is for trees."""
    if kind in ("lr", "bayes"):
        train, test = hashed_split(spark, sf_dir, m)
        return mldata.hashed_dataset(train, m), mldata.hashed_dataset(test, m)
    imp = load_impressions(spark, sf_dir)
    rows = stage(mldata.asis_dataset(imp, "event_id", "day"), "asis-rows", partition_by="day")
    train, test = sampling.holdout_split(rows)
    return train.drop("day"), test.drop("day")


def sweep_rows(spark: SparkSession, sf_dir: str, kind: str, spaces: list[int]):
    """(train, test, dataset): the rows of a kind, hashed once for all ``spaces``, and ``dataset(rows, m)``: some of them as an ML dataset."""
    if kind not in ("lr", "bayes"):
        return *ml_datasets(spark, sf_dir, kind), lambda rows, m: rows
    columns = {f"indices_{m}": m for m in spaces}
    coded = hashing.packed_hash_spaces(load_impressions(spark, sf_dir), columns, "event_id", "day", "label")
    train, test = sampling.holdout_split(stage(coded, "hashed-spaces", partition_by="day"))
    return train, test, lambda rows, m: mldata.hashed_dataset(rows, m, indices=f"indices_{m}")


SCAN_SHARE = 10  # samples of under a tenth of the rows are staged by one scan; sorting larger ones by sample costs more than a scan


def sweep_samples(train: DataFrame, sizes: list[int], total: int) -> dict[int, DataFrame]:
    """R2 for each size, salted by its name; a size is drawn once, whatever is fitted on it."""
    few = sampling.exact_samples(train, "event_id", {py_size_to_name(n): n for n in sizes if n * SCAN_SHARE <= total}, total)
    return {n: few.get(py_size_to_name(n)) or sampling.exact_sample(train, "event_id", n, salt=py_size_to_name(n), total=total) for n in sizes}


def ml_sweep(spark: SparkSession, sf_dir: str, kinds: Iterable[str], sizes: Iterable[int],
             partitions: int | None = None, overrides: dict | None = None, spaces: Iterable[int] = (100_000,),
             series: str = "{}") -> DataFrame:
    """M5-M7: (engine, train_size, roc_auc, log_loss, train_time) for Spark ML classifiers.

    ``spaces`` are the hash spaces of the hashed kinds; ``series`` names an engine from its kind and space.
    """
    rows = []
    for kind in kinds:
        own = list(spaces) if kind in ("lr", "bayes") else [0]
        train, test, dataset = sweep_rows(spark, sf_dir, kind, own)
        total = train.count()
        samples = sweep_samples(train, sizes_upto(sizes, total), total)
        for m, n in ((m, n) for m in own for n in samples):
            tr = dataset(samples[n], m)
            # the cut of a small sample leaves its rows in one task, beside empty ones
            tasks = partitions or (tasks_for(spark, n) if n < total else None)
            if tasks:
                tr = tr.repartition(tasks)
            with learn.persisted(tr, learn.input_level(kind)) as cached:
                have = cached.count()
                model, secs = learn.fit_timed(
                    learn.make_classifier(kind, have, **(overrides or {}).get(kind, {})), cached)
            ev = learn.evaluate(model, test=dataset(test, m))["test"]
            rows.append((series.format(kind, py_size_to_name(m) if m else ""), min(int(n), total), ev["roc_auc"], ev["log_loss"], float(secs)))
    return spark.createDataFrame(
        rows, "engine string, train_size bigint, roc_auc double, log_loss double, train_time double")


def cross_validate(spark: SparkSession, sf_dir: str, kind: str, grid: dict[str, Iterable], folds: int = 5) -> DataFrame:
    """M8: k-fold CV of a classifier over all combinations of ``grid``, on all train rows, by log loss."""
    train, _ = ml_datasets(spark, sf_dir, kind)
    classifier = learn.make_classifier(kind)
    build = ParamGridBuilder()
    for name, values in grid.items():
        build.addGrid(classifier.getParam(name), list(values))
    cells = build.build()
    ev = MulticlassClassificationEvaluator(metricName="logLoss")
    cv = CrossValidator(estimator=classifier, estimatorParamMaps=cells, evaluator=ev, numFolds=folds,
                        seed=learn.SEED, parallelism=min(4, len(cells)))
    with learn.persisted(train.select("label", "features")) as cached:
        model = cv.fit(cached)
    rows = [(*(float(cell[classifier.getParam(name)]) for name in grid), float(v))
            for cell, v in zip(cells, model.avgMetrics)]
    return spark.createDataFrame(rows, ", ".join(f"{name} double" for name in [*grid, "cv_log_loss"]))


def parallelism_sweep(spark: SparkSession, sf_dir: str, cores: Iterable[int] | None = None) -> DataFrame:
    """LR train time on all train rows against the cores at work: (cores, tasks, train_rows, train_time).

    Every pass of the fit runs one task a partition, so a train set of p
    partitions occupies p cores at most; the sweep doubles p up to the session's
    parallelism.  (A resource profile a stage would bound executors as well,
    but needs dynamic allocation, which a local session has not.)
    """
    train, _ = ml_datasets(spark, sf_dir, "lr")
    tr = stage(train, "parallel-train")
    most = spark.sparkContext.defaultParallelism
    rows = []
    for p in cores or [k for k in (1 << i for i in range(31)) if k <= most]:
        with learn.persisted(tr.repartition(p), learn.input_level("lr")) as cached:
            n = cached.count()
            t0 = time.perf_counter()
            learn.make_classifier("lr").fit(cached)
            rows.append((min(p, most), int(p), int(n), time.perf_counter() - t0))
    return spark.createDataFrame(rows, "cores int, tasks int, train_rows bigint, train_time double")


def fit_and_evaluate(spark: SparkSession, sf_dir: str, kind: str, overrides: dict | None = None
                     ) -> DataFrame:
    """One classifier on all train rows: (engine, train_size, roc_auc, log_loss, train_time)."""
    train, test = ml_datasets(spark, sf_dir, kind)
    with learn.persisted(train.select("label", "features"), learn.input_level(kind)) as cached:
        n = cached.count()
        model, secs = learn.fit_timed(learn.make_classifier(kind, n, **(overrides or {})), cached)
    ev = learn.evaluate(model, test=test)["test"]
    return spark.createDataFrame(
        [(kind, int(n), ev["roc_auc"], ev["log_loss"], float(secs))],
        "engine string, train_size bigint, roc_auc double, log_loss double, train_time double")


def evaluator_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7 vs A6: Spark ML's exact evaluator AUC against the distributed exact AUC."""
    train, test = ml_datasets(spark, sf_dir, "lr")
    with learn.persisted(train.select("label", "features")) as cached:
        model = learn.make_classifier("lr").fit(cached)
    pred = model.transform(test)
    ev = metrics.evaluator_auc(pred, "label", "probability", exact=True)
    ours = metrics.roc_auc(learn.predictions(model, test), "label", "p").first()[0]
    return spark.createDataFrame([(ev, ours, abs(ev - ours))],
                                 "evaluator_auc double, exact_auc double, abs_diff double")


def key_fold(key: str, folds: int):
    """M8: fold of a row by the md5 of its key, so that a row stays in its fold whatever else is read."""
    return (F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint") % folds).cast("int")


def bayes_cross_validation(spark: SparkSession, sf_dir: str, alphas: Iterable[float], folds: int = 5, m: int = 100_000) -> DataFrame:
    """M8, checked form: (alpha, fold, n_rows, log_loss) of naive Bayes on the train days, all cells from one aggregate of counts."""
    train, _ = hashed_split(spark, sf_dir, m)
    alphas = [float(a) for a in alphas]
    rows = stage(train.withColumn("fold", key_fold("event_id", folds)), "cv-rows")
    counts, n1, n0 = grouped.group_counts(rows, "fold", folds)
    models = grouped.fit_from_counts(counts, n1, n0, [[g for g in range(folds) if g != k] for k in range(folds)], m, alphas)
    scored = grouped.scores(rows, models, [F.col("fold") * len(alphas) + i for i in range(len(alphas))])
    terms = [F.struct(F.lit(a).alias("alpha"), metrics.log_loss_of(F.col("label"), linear.sigmoid_fixed(F.col(f"score_{i}"))).alias("ll"))
             for i, a in enumerate(alphas)]
    long = scored.select("fold", F.explode(F.array(*terms)).alias("t")).select("fold", "t.alpha", "t.ll")
    return long.groupBy("alpha", "fold").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("ll").alias("log_loss"))


NESTED_SALT = "nested"


def nested_curve(spark: SparkSession, sf_dir: str, sizes: Iterable[int] = SWEEP_LADDER, m: int = 100_000) -> DataFrame:
    """M6 in one pass: nested samples by hash rank, every rung's model from one aggregate of counts: (train_size, roc_auc, log_loss).

    A row's rung is the smallest size whose sample (the rows of smallest md5)
    holds it; a rung's counts are those of all rungs up to it.
    """
    train, test = hashed_split(spark, sf_dir, m)
    hashed = train.withColumn("_h", sampling.sample_hash("event_id", NESTED_SALT))
    ranked = ordering.global_index(hashed, ["_h", "event_id"], "_rank").drop("_h")
    total = train.count()
    ladder_sizes = sizes_upto(sizes, total)
    rung = F.lit(None).cast("int")
    for k in reversed(range(len(ladder_sizes))):
        rung = F.when(F.col("_rank") < ladder_sizes[k], F.lit(k)).otherwise(rung)
    counts, n1, n0 = grouped.group_counts(ranked.withColumn("rung", rung), "rung", len(ladder_sizes))
    models = grouped.fit_from_counts(counts, n1, n0, [list(range(k + 1)) for k in range(len(ladder_sizes))], m, [1.0])
    scored = grouped.scores(test, models, list(range(len(models))))
    parts = {str(min(n, total)): linear.sigmoid_fixed(F.col(f"score_{k}")) for k, n in enumerate(ladder_sizes)}
    return metrics.many_metrics(scored, parts).select(F.col("part").cast("bigint").alias("train_size"), "roc_auc", F.round("log_loss", 9).alias("log_loss"))


def click_rates(imp: DataFrame, columns: list[str]) -> DataFrame:
    """(value, day, n, clicks, click_rate) per feature value and day: a long metric table of any length for the report operators."""
    long = imp.unpivot(["day", "label_click"], columns, "feature", "v").where("v IS NOT NULL")
    per = long.groupBy(F.concat_ws("=", "feature", "v").alias("value"), F.concat(F.lit("d"), "day").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("label_click").cast("bigint").alias("clicks"))
    return per.withColumn("click_rate", F.col("clicks") / F.col("n"))
