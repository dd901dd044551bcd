"""Sinks and job control around written data (K1, K2, K4, K5, K6, staging).

* ``stage``: write a table to the shared staging folder and read it back: a
  durable lineage cut (survives executor loss; never a machine-local folder
  on a cluster) that lets later jobs scan only the columns and partitions they
  need.
* ``write_once``: K2 resumable sink: skip when ``_SUCCESS`` exists, otherwise
  clear partial output and write.
* ``write_text`` / ``verify_count``: K1 and K5.
* ``clear_staging``: delete what this application staged, once its results are read.
* ``append_metrics``: K6, metric rows appended as TSV with a header.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from impressa.schema import METRIC_HEADER
from impressa.session import staging_dir, staging_root


class CountMismatch(RuntimeError):
    pass


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def is_complete(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, path.rstrip("/") + "/_SUCCESS")


def mark_complete(spark: SparkSession, path: str) -> None:
    """Set the marker that ``is_complete`` looks for."""
    fs, p = _fs(spark, path.rstrip("/") + "/_SUCCESS")
    fs.create(p, True).close()


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    if fs.exists(p):
        fs.delete(p, True)


def stage(df: DataFrame, name: str, partition_by: str | list[str] | None = None,
          files: int | None = None) -> DataFrame:
    """Write ``df`` as parquet under the staging folder and return a scan of it."""
    spark = df.sparkSession
    path = staging_dir(spark, name)
    out = df.repartition(files) if files else df
    w = out.write.mode("overwrite").format("parquet")
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.save(path)
    return spark.read.parquet(path)


def clear_staging(spark: SparkSession) -> None:
    """Delete everything this application staged; results not yet read or written elsewhere are lost."""
    delete_path(spark, staging_root(spark))


def write_once(spark: SparkSession, path: str, build: Callable[[], DataFrame],
               write: Callable[[DataFrame, str], None]) -> bool:
    """K2: run ``write(build(), path)`` unless ``path`` already holds a complete output.

    Returns True when it wrote.  A partial output (no ``_SUCCESS``) is removed
    first, so a killed job restarts cleanly.  ``build`` is only called when
    the write happens, so skipped chunks cost no planning or reading.
    """
    if is_complete(spark, path):
        return False
    delete_path(spark, path)
    write(build(), path)
    return True


def write_text(df: DataFrame, path: str, column: str = "value", files: int | None = None,
               mode: str = "overwrite") -> None:
    """K1 (+K4 when ``files`` is set): one text line per row."""
    out = df.select(column)
    if files:
        out = out.repartition(files)
    out.write.mode(mode).text(path)


def verify_count(spark: SparkSession, path: str, expected: int, fmt: str = "text") -> int:
    """K5: read the written output back and check its row count."""
    n = spark.read.format(fmt).load(path).count()
    if n != expected:
        raise CountMismatch(f"{path}: {n} rows written, {expected} expected")
    return n


def append_metrics(df: DataFrame, path: str) -> None:
    """K6: append metric rows as TSV; each append writes its own header line."""
    cols = [c for c in df.columns]
    renamed = df.select(*[df[c].alias(METRIC_HEADER.get(c, c)) for c in cols])
    (renamed.coalesce(1).write.mode("append").option("sep", "\t").option("header", "true")
     .option("quoteAll", "false").csv(path))
