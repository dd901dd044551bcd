"""Many naive Bayes models from one scan, by counts per group of rows (M6 nested curve, M8 folds).

Rows fall into few groups (folds, rungs of a sample ladder).  One grouped
aggregate counts every hashed index per group and class; a model that learns
from some of the groups is a sum over their counts.  So k folds are k
subtractions from the total, and the rungs of a ladder are running sums, and
neither reads the rows again.

Weights are fixed point as in ``linear``; every index that any group holds gets
a weight in every model.  The weights of all models are arrays of the hash
space, one scalar of the query (models x hash space entries, checked), and
scoring is a narrow map.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impressa.operators.linear import DENSE_MAX, SCALE, _q
from impressa.sources.sinks import stage


@dataclass
class GroupedModels:
    """``weights``: idx, w0..; one intercept and one weight of unseen indices a model."""

    weights: DataFrame
    intercepts: list[int]
    defaults: list[int]
    m: int

    def __len__(self) -> int:
        return len(self.intercepts)


def group_counts(rows: DataFrame, group: str, groups: int, label: str = "label", indices: str = "indices"
                 ) -> tuple[DataFrame, list[int], list[int]]:
    """(idx, c1_<k>, c0_<k>) for every group k, and the rows of class 1 and 0 in every group.

    Rows with a null group or label count nowhere.
    """
    y, g = F.col("_y"), F.col("_g")
    own = rows.select(F.col(label).cast("bigint").alias("_y"), F.col(group).alias("_g"), F.col(indices).alias("_i")).where("_y IS NOT NULL AND _g IS NOT NULL")
    sums = [F.coalesce(F.sum(F.when(g == k, x)), F.lit(0)).cast("bigint").alias(f"c{c}_{k}") for k in range(groups) for c, x in ((1, y), (0, 1 - y))]
    counts = stage(own.select("_y", "_g", F.explode("_i").alias("idx")).groupBy("idx").agg(*sums), "group-counts")
    tot = own.agg(*sums).first()
    return counts, [tot[f"c1_{k}"] for k in range(groups)], [tot[f"c0_{k}"] for k in range(groups)]


def member_counts(rows: DataFrame, members: list[Column], label: str = "label", indices: str = "indices"
                  ) -> tuple[DataFrame, list[int], list[int]]:
    """``group_counts`` for groups that may overlap: group k has the rows for which ``members[k]`` holds (at most 62 groups)."""
    if len(members) > 62:
        raise ValueError(f"{len(members)} groups do not fit one number a row")
    mask = F.lit(0).cast("bigint")
    for k, member in enumerate(members):
        mask = mask + F.when(member, F.lit(1 << k)).otherwise(F.lit(0))
    y = F.col(label).cast("bigint")
    own = rows.select(mask.cast("bigint").alias("_in"), y.alias("_y"), F.col(indices).alias("_i")).where("_y IS NOT NULL AND _in <> 0")
    own = own.select(F.when(F.col("_y") == 1, F.col("_in")).otherwise(0).alias("_in1"), F.when(F.col("_y") == 0, F.col("_in")).otherwise(0).alias("_in0"), "_i")
    sums = [F.sum(F.shiftright(f"_in{c}", k).bitwiseAND(F.lit(1))).cast("bigint").alias(f"c{c}_{k}") for k in range(len(members)) for c in (1, 0)]
    # the rows without an index are the totals, so that one pass gives both
    keyed = own.select("_in1", "_in0", F.explode(F.concat(F.array(F.lit(-1)), F.coalesce("_i", F.array().cast("array<int>")))).alias("idx"))
    counts = stage(keyed.groupBy("idx").agg(*sums), "member-counts")
    tot = counts.where("idx = -1").first()
    n1, n0 = ([int(tot[f"c{c}_{k}"]) if tot else 0 for k in range(len(members))] for c in (1, 0))
    return counts.where("idx >= 0"), n1, n0


def fit_from_counts(counts: DataFrame, n1: list[int], n0: list[int], uses: list[list[int]], m: int,
                    alphas: list[float], scale: int = SCALE, seen_only: bool = False) -> GroupedModels:
    """A model for every set of groups in ``uses`` and every smoothing in ``alphas`` (the latter varies fastest).

    Weights are those of ``linear.fit_bernoulli_bayes`` on the rows of these
    groups; with ``seen_only`` an index that none of them holds has the weight
    of unseen indices, as there, to the last digit.
    """
    cols, intercepts, defaults, sums = [], [], [], []
    models = [(u, a) for u in uses for a in alphas]
    for k, (use, alpha) in enumerate(models):
        t1, t0 = sum(n1[g] for g in use), sum(n0[g] for g in use)
        d1, d0 = math.log(t1 + 2 * alpha), math.log(t0 + 2 * alpha)
        c1, c0 = (sum((F.col(f"c{c}_{g}") for g in use[1:]), F.col(f"c{c}_{use[0]}")) for c in (1, 0))
        lt1, lt0 = F.log(c1 + alpha) - F.lit(d1), F.log(c0 + alpha) - F.lit(d0)
        ln1 = F.log(F.lit(t1 + 2 * alpha) - c1 - alpha) - F.lit(d1)
        ln0 = F.log(F.lit(t0 + 2 * alpha) - c0 - alpha) - F.lit(d0)
        w, absent = F.round((lt1 - ln1 - lt0 + ln0) * scale).cast("bigint"), F.round((ln1 - ln0) * scale).cast("bigint")
        if seen_only:
            w, absent = F.when(c1 + c0 > 0, w), F.when(c1 + c0 > 0, absent)
        cols += [w.alias(f"w{k}"), absent.alias(f"absent{k}")]
        sums += [F.sum(f"absent{k}").alias(f"absent{k}"), F.count(f"w{k}").alias(f"n{k}")]
        u, v1, v0 = math.log(alpha), math.log(t1 + alpha) - d1, math.log(t0 + alpha) - d0
        v = v1 - v0
        defaults.append(_q(((u - d1) - v1) - ((u - d0) - v0) if seen_only else (u - d1) - v1 - (u - d0) + v0, scale))
        intercepts.append((_q(math.log(t1 + alpha) - math.log(t0 + alpha), scale), v))
    weights = stage(counts.select(F.col("idx").cast("int").alias("idx"), *cols), "group-weights")
    seen = weights.agg(*sums).first()
    total = [prior + int(seen[f"absent{k}"] or 0) + _q((m - seen[f"n{k}"]) * v, scale) for k, (prior, v) in enumerate(intercepts)]
    return GroupedModels(weights.select("idx", *[f"w{k}" for k in range(len(models))]), total, defaults, m)


def scores(rows: DataFrame, models: GroupedModels, pick: list[Column | int], indices: str = "indices",
           dense_max: int = 4 * DENSE_MAX) -> DataFrame:
    """``rows`` with ``score_0``, ``score_1`` ...: for each entry of ``pick``, the fixed-point score by the model of that number (a column or a constant)."""
    if models.m * len(models) > dense_max:
        raise ValueError(f"{len(models)} models of {models.m} weights exceed {dense_max} entries; score fewer at a time")
    spark = rows.sparkSession
    names = [f"w{k}" for k in range(len(models))]
    every = spark.range(models.m).select(F.col("id").cast("int").alias("idx")).join(models.weights, "idx", "left")
    entry = F.struct("idx", *[F.coalesce(n, F.lit(d)).alias(n) for n, d in zip(names, models.defaults)])
    sorted_all = every.agg(F.sort_array(F.collect_list(entry)).alias("a"))
    # All weights, model after model.  Used once below, so that Spark keeps the scalar inside that expression: as a
    # column of its own it would be copied with every row.
    dense = sorted_all.select(F.concat(*[F.col(f"a.{n}") for n in names]).alias("a")).scalar()
    numbers = [F.lit(k) if isinstance(k, int) else k.cast("int") for k in pick]
    columns = rows.columns
    ids = F.coalesce(F.col(indices), F.array().cast("array<int>"))
    sums = F.transform(F.array(*[k * models.m for k in numbers]),
                       lambda first: F.aggregate(ids, F.lit(0).cast("bigint"), lambda acc, j: acc + F.get(F.col("_w"), first + j)))
    intercepts = F.array(*[F.lit(b).cast("bigint") for b in models.intercepts])
    out = rows.withColumn("_w", dense).select(*columns, sums.alias("_sums"))
    return out.select(*columns, *[(F.get(intercepts, k) + F.get("_sums", F.lit(i))).cast("bigint").alias(f"score_{i}") for i, k in enumerate(numbers)])
