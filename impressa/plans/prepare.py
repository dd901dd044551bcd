"""Entry A: raw impressions -> LibSVM by day -> exact sample ladder -> shuffled VW.

Each stage is one distributed job per chunk; chunks (days, sample sizes) are
resumable: an output with ``_SUCCESS`` is skipped, a partial one is cleared
and rewritten (K2).  The driver loop only iterates over chunk names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impressa.functions import encode
from impressa.functions.names import py_size_to_name
from impressa.operators import ordering, sampling
from impressa.sources import sinks
from impressa.sources.impressions import read_raw
from impressa.sources.sinks import stage


def write_lines_once(spark: SparkSession, outputs: dict[str, Callable[[], DataFrame]],
                     files: int | None = None) -> list[str]:
    """K3: each output path gets the ``value`` lines of its builder as text, unless it is complete already.

    Returns the paths written by this call.
    """
    return [path for path, lines in outputs.items()
            if sinks.write_once(spark, path, lines, lambda df, p: sinks.write_text(df, p, "value", files))]


def convert_days(spark: SparkSession, raw_root: str, out_root: str, days: Iterable[int]) -> list[int]:
    """K3 over raw days as one job: all days not yet complete go to LibSVM text under ``day=N``.

    Large days are split over tasks and small ones share them.  A day's
    ``_SUCCESS`` is set after the whole job has committed, so the days of a
    killed job are cleared and converted again.  Returns the days written.
    """
    todo = [d for d in days if not sinks.is_complete(spark, f"{out_root}/day={d}")]
    if not todo:
        return todo
    for d in todo:
        sinks.delete_path(spark, f"{out_root}/day={d}")
    rows = read_raw(spark, raw_root).where(F.col("day").isin(todo))
    lines = rows.select(encode.libsvm_line().alias("value"), "day").hint("rebalance", "day")
    lines.write.mode("append").partitionBy("day").text(out_root)
    for d in todo:
        sinks.mark_complete(spark, f"{out_root}/day={d}")
    return todo


def impressions_to_libsvm(df: DataFrame) -> DataFrame:
    """P1 as a converter: impressions -> ``value`` LibSVM lines."""
    return df.select(encode.libsvm_line().alias("value"))


def index_hash_order(lines: DataFrame, index: str = "line_no") -> DataFrame:
    """O1 as a transform: numbered lines (``lines.numbered_lines``) in ascending md5(text of their index)."""
    return ordering.sorted_shuffle(lines, index).drop(index)


def write_ladder(spark: SparkSession, data: DataFrame, sizes: Iterable[int], out_template: str,
                 key: str, files: int | None = None, column: str = "value") -> list[tuple[str, int]]:
    """Exact samples of every size, drawn in one scan of ``data``, each written
    once (K2), capped to ``files`` files (K4) and verified by reading back (K5).

    Sizes are salted by their own name, so samples of different sizes are
    independent; complete sizes are not drawn again.  Returns (name, rows).
    """
    total = data.count()
    want = {py_size_to_name(n): int(n) for n in sizes}
    todo = {s: n for s, n in want.items() if not sinks.is_complete(spark, out_template.format(s))}
    for s, df in sampling.exact_samples(data, key, todo, total).items():
        sinks.write_once(spark, out_template.format(s), lambda df=df: df,
                         lambda df, path: sinks.write_text(df, path, column, files))
    return [(s, sinks.verify_count(spark, out_template.format(s), min(n, total))) for s, n in want.items()]
