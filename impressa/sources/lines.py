"""Text lines in the order of their files (W1 and J2 on files).

A line's place is (file path, start of its split in the file, line within the
split).  Spark packs splits of many files into a task in an order of its own,
by size, so a task's row counter alone says nothing about the order of files.
But within one split lines keep their order, so a split's lines are numbered by
the counter less its least value there, and a split begins where the lines of
all earlier splits end: one row a split, no line is sorted or moved.

``numbered_lines`` gives every line the index that reading the files, sorted by
path, as text with ``zipWithIndex`` gives.  Null and empty lines count as lines; a path
without lines gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impressa.operators.ordering import prefix_sums
from impressa.sources.impressions import read_lines
from impressa.sources.sinks import stage

UNEQUAL = "inputs of unequal length"
RESPLIT = "lines were split otherwise when they were counted"
_PLACE = ["_file", "_start"]


def numbered_lines(spark: SparkSession, paths: str | list[str], out: str = "line_no", value: str = "value") -> DataFrame:
    """W1 of text files: (value, ``out``), 0-based in the order of file paths and of lines within them.

    Only the splits, a row for each, are staged and broadcast: no line is
    written again or shuffled.  The lines are scanned anew; should a later scan be
    split otherwise (other settings, small files and other cores), some
    line falls outside its split's count, and the job that reads it raises.
    """
    scan = read_lines(spark, paths).select(
        F.col("value").alias(value), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row"))
    splits = stage(scan.groupBy(*_PLACE).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first")), "line-splits")
    before = prefix_sums(splits, _PLACE, {"_before": F.col("_n")}, inclusive=False)
    joined = scan.join(F.broadcast(before), _PLACE, "left")
    within = F.col("_row") - F.col("_first")
    line = F.when((within >= 0) & (within < F.col("_n")), F.col("_before") + within).otherwise(F.raise_error(F.lit(RESPLIT)).cast("bigint"))
    return joined.select(value, line.cast("bigint").alias(out))


def first_field(column: str, kind: str):
    """The text before the first space, as ``kind``; null where it is none."""
    return F.split_part(F.col(column), F.lit(" "), F.lit(1)).try_cast(kind)


def zip_lines(left: DataFrame, right: DataFrame, on: str = "line_no") -> DataFrame:
    """J2 by position: line i of one side with line i of the other.

    ``on`` numbers the lines of each side without gaps; where one side is
    longer, the job that reads the result raises.
    """
    rest = [c for c in left.columns if c != on], [c for c in right.columns if c != on]
    a = left.select(F.col(on).alias("_l"), F.struct(*rest[0]).alias("_left"))
    b = right.select(F.col(on).alias("_r"), F.struct(*rest[1]).alias("_right"))
    j = a.join(b, F.col("_l") == F.col("_r"), "full_outer")
    told = F.concat(F.lit(UNEQUAL + ": only one has line "), F.coalesce("_l", "_r").cast("string"))
    both = F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), F.lit(True)).otherwise(F.raise_error(told).cast("boolean"))
    return j.where(both).select(F.col("_l").alias(on), "_left.*", "_right.*")


def pair_files(spark: SparkSession, labels: str, scores: str) -> DataFrame:
    """J2/S6 for files without ids: (line_no, label, score) from the first field of line i of either path."""
    a = numbered_lines(spark, labels, value="_text").select("line_no", first_field("_text", "int").alias("label"))
    b = numbered_lines(spark, scores, value="_text").select("line_no", first_field("_text", "double").alias("score"))
    return zip_lines(a, b)
