"""Raw impression TSV and text-line sources.

The raw format is tab-separated, headerless, 40 columns (label, 13 integer
features, 26 hex categoricals), empty field = null, one directory per day.
It is always read with the explicit schema.  The day comes from the path
(``day=N`` or ``day_N``), so a day filter prunes whole directories.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impressa.schema import FEATURE_COLS, IMPRESSION, METRIC_EXTENDED, METRIC_HEADER

DAY_IN_PATH = r"day[=_](\d+)"


def write_raw(imp: DataFrame, root: str, partition_by_day: bool = True) -> None:
    """Write impressions in the raw TSV layout (``root/day=N/part-*``)."""
    cols = ["label"] + FEATURE_COLS + (["day"] if partition_by_day else [])
    w = imp.select(*cols).write.mode("overwrite").option("sep", "\t").option("header", "false")
    if partition_by_day:
        w = w.partitionBy("day")
    w.csv(root)


def read_raw(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Raw TSV (one path, a glob or a list) -> IMPRESSION columns + ``day``.

    The day is parsed from each file's path, so any layout that names the day
    (``day=7/``, ``day_7``, ``day_7.gz``) works with globs over many days.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    df = (spark.read.schema(IMPRESSION).option("sep", "\t").option("header", "false")
          .option("mode", "FAILFAST").csv(paths))
    day = F.regexp_extract(F.col("_metadata.file_path"), DAY_IN_PATH, 1)
    return df.withColumn("day", F.when(day != "", day.cast("int")))


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Text lines (one ``value`` column)."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.text(paths)


def union_days(parts: list[DataFrame]) -> DataFrame:
    """Union of per-day datasets (by column name)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_key_value_lines(spark: SparkSession, path: str, key: str, value: str,
                         value_type: str = "double") -> DataFrame:
    """S6 helper: lines ``<key> <value> ...`` -> (key BIGINT, value)."""
    parts = F.split(F.col("value"), " ")
    return read_lines(spark, path).select(
        parts.getItem(0).cast("bigint").alias(key), parts.getItem(1).cast(value_type).alias(value))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metric TSV with a (quoted or plain) header, columns found by header name, explicit types.

    Repeated header lines (one per append) are dropped; columns that the header
    lacks are null; an unknown header name or a value that is not of its column's type raises.
    """
    head = spark.read.option("sep", "\t").option("quote", '"').option("header", "true").csv(path).columns
    known = {v: k for k, v in METRIC_HEADER.items()}
    if unknown := [h for h in head if h not in known]:
        raise ValueError(f"unknown metric columns: {unknown}")
    raw = (spark.read.option("sep", "\t").option("header", "false").option("quote", '"').option("mode", "FAILFAST")
           .schema(", ".join(f"{known[h]} string" for h in head)).csv(path))
    body = raw.where(F.col(known[head[0]]).isNull() | (F.col(known[head[0]]) != head[0]))
    return body.select(*[(F.col(f.name) if f.name in raw.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                         for f in METRIC_EXTENDED.fields])
