"""K3 as a file stream: raw day files -> LibSVM text, each file converted once.

The reference converts day chunks in a driver loop and skips chunks whose
output is complete.  A Structured Streaming file source with a checkpoint
gives the same contract at file granularity: every input file is processed
exactly once, a killed run resumes from the checkpoint, and the file sink only
exposes committed batches.  ``availableNow`` processes what is there and
stops, so the job can run on a schedule as new days land.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from impressa.functions import encode
from impressa.schema import IMPRESSION
from impressa.sources.impressions import DAY_IN_PATH


def convert_stream(spark: SparkSession, raw_glob: str, out_path: str, checkpoint: str,
                   max_files_per_trigger: int | None = None) -> None:
    """Convert all raw TSV files under ``raw_glob`` not yet converted; wait for it."""
    reader = (spark.readStream.schema(IMPRESSION).option("sep", "\t").option("header", "false").option("mode", "FAILFAST"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.csv(raw_glob)
    day = F.regexp_extract(F.col("_metadata.file_path"), DAY_IN_PATH, 1).cast("int")
    lines = raw.select(encode.libsvm_line().alias("value"), day.alias("day"))
    q = (lines.writeStream.format("text").partitionBy("day")
         .option("checkpointLocation", checkpoint).option("path", out_path)
         .trigger(availableNow=True).start())
    q.awaitTermination()
