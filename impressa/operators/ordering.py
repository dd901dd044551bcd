"""Distributed global order operators: W1 (row index), W2 (prefix sums), O1, O3.

A ``row_number()`` or running ``sum`` over an unpartitioned window moves every
row into one task.  Instead, rows are cut into ordered ranges of the whole
order tuple (``repartitionByRange``, sampled bounds), and the ranges are staged
with their number, so that every later job, also one rerun after an executor
loss, sees the same cut.  Totals per range (one row per range) give each range
its offset by a small join, and a window inside each range finishes the job.

The cut is on the tuple, so a value that many rows share is split by the
columns after it, ids of any size are compared as they are, and nulls come
first in the cut as in the windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from impressa.sources.sinks import stage

RANGE = "_range"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cut_ranges(df: DataFrame, order_by: list, ranges: int | None = None) -> DataFrame:
    """``df`` staged in ordered ranges of the tuple ``order_by``, with their number in ``_range``."""
    n = int(ranges or 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    parts = df.repartitionByRange(max(1, n), *[_col(c).asc() for c in order_by])
    return stage(parts.withColumn(RANGE, F.spark_partition_id()), "ranges")


def _with_offsets(cut: DataFrame, sums: dict[str, Column]) -> tuple[DataFrame, dict[str, str]]:
    """Add ``_before_<name>``: the sum over all earlier ranges (a join with one row per range)."""
    totals = sorted(cut.groupBy(RANGE).agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(k) for k, v in sums.items()]).collect())
    names = {k: f"_before_{k}" for k in sums}
    rows, acc = [], dict.fromkeys(sums, 0)
    for t in totals:
        rows.append((t[RANGE], *acc.values()))
        acc = {k: acc[k] + t[k] for k in acc}
    types = cut.select(*[F.sum(v).alias(k) for k, v in sums.items()]).schema
    schema = ", ".join([f"{RANGE} int"] + [f"{names[k]} {types[k].dataType.simpleString()}" for k in sums])
    return cut.join(cut.sparkSession.createDataFrame(rows, schema), RANGE), names


def global_index(df: DataFrame, order_by: list, out: str = "row_idx", ranges: int | None = None) -> DataFrame:
    """0-based position of each row in the total order ``order_by`` (ends in a unique key; nulls first)."""
    cut, names = _with_offsets(cut_ranges(df, order_by, ranges), {"n": F.lit(1).cast("bigint")})
    w = Window.partitionBy(RANGE).orderBy(*[_col(c) for c in order_by])
    return (cut.withColumn(out, (F.col(names["n"]) + F.row_number().over(w) - 1).cast("bigint"))
            .drop(RANGE, *names.values()))


def prefix_sums(df: DataFrame, order_by: list, values: dict[str, Column], inclusive: bool = True,
                ranges: int | None = None) -> DataFrame:
    """Running sums of ``values`` along the total order ``order_by``.

    Adds one column per entry of ``values``; inclusive sums count the current
    row, exclusive ones only the rows before it.
    """
    cut, names = _with_offsets(cut_ranges(df, order_by, ranges), values)
    frame = (Window.partitionBy(RANGE).orderBy(*[_col(c) for c in order_by])
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    for k, v in values.items():
        running = F.col(names[k]) + F.sum(v).over(frame)
        cut = cut.withColumn(k, running if inclusive else running - v)
    return cut.drop(RANGE, *names.values())


def md5_order_key(c) -> Column:
    """md5 hex of the value's text: the order of O1 and R2."""
    return F.md5(_col(c).cast("string"))


def shuffle_order(df: DataFrame, index_col: str, out: str = "shuffle_pos",
                  ranges: int | None = None) -> DataFrame:
    """O1: deterministic pseudo-random permutation: ascending md5(text of index).

    Returns ``df`` with ``out`` = position in the shuffled order; the md5 text
    is unique per index, so the order is total.
    """
    h = "_shuffle_md5"
    return global_index(df.withColumn(h, md5_order_key(index_col)), [h], out, ranges).drop(h)


def sorted_shuffle(df: DataFrame, index_col: str) -> DataFrame:
    """O1 for writing: rows globally sorted by md5(index) (range-partitioned sort)."""
    return df.orderBy(F.md5(F.col(index_col).cast("string")))


def take_first(df: DataFrame, order_by: list, n: int, ranges: int | None = None) -> DataFrame:
    """O3: exactly min(n, N) first rows of a total order, for any ``n``.

    Ranges that end within the first n rows pass whole, later ones not at all;
    only the range that holds the n-th row is numbered.
    """
    n = int(n)
    if n <= 0:
        return df.limit(0)
    cut, names = _with_offsets(cut_ranges(df, order_by, ranges), {"n": F.lit(1).cast("bigint")})
    w = Window.partitionBy(RANGE).orderBy(*[_col(c) for c in order_by])
    kept = cut.where(F.col(names["n"]) < n).withColumn("_nth", F.col(names["n"]) + F.row_number().over(w))
    return kept.where(F.col("_nth") <= n).drop(RANGE, "_nth", *names.values())
