"""Explicit schemas and fixed format constants.

Schemas are never inferred: hex categoricals would be misread as integers or
doubles by inference.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the click-log format (must match the reference's layout):
# column 0 is the label, columns 1..13 are integer features, columns 14..39 are
# categorical features written as 8-digit hex of a 32-bit hash.
N_NUMERIC = 13
FIRST_CATEGORICAL = 14
LAST_CATEGORICAL = 39
NUMERIC_COLS = [f"i{k}" for k in range(1, N_NUMERIC + 1)]
CATEGORICAL_COLS = [f"c{k}" for k in range(FIRST_CATEGORICAL, LAST_CATEGORICAL + 1)]
FEATURE_COLS = NUMERIC_COLS + CATEGORICAL_COLS
FEATURE_INDEX = {name: k for k, name in enumerate(FEATURE_COLS, start=1)}

# Default hash space, as-is vector size (index 0 unused), and the
# log-loss probability clip.
DEFAULT_HASH_SPACE = 100_000
ASIS_VECTOR_SIZE = 40
LOGLOSS_EPS = 1e-15

IMPRESSION = T.StructType(
    [T.StructField("label", T.IntegerType(), True)]
    + [T.StructField(c, T.LongType(), True) for c in NUMERIC_COLS]
    + [T.StructField(c, T.StringType(), True) for c in CATEGORICAL_COLS]
)

# Metric table layout: Engine, Train size, ROC AUC, Log loss, Train time
# (+ Maximum memory, CPU load for local runs).  Stored with snake_case names.
METRIC = T.StructType([
    T.StructField("engine", T.StringType(), True),
    T.StructField("train_size", T.LongType(), True),
    T.StructField("roc_auc", T.DoubleType(), True),
    T.StructField("log_loss", T.DoubleType(), True),
    T.StructField("train_time", T.DoubleType(), True),
])
METRIC_EXTENDED = T.StructType(METRIC.fields + [
    T.StructField("max_memory", T.LongType(), True),
    T.StructField("cpu_load", T.DoubleType(), True),
])
# Header names as written in metric TSV files.
METRIC_HEADER = {
    "engine": "Engine", "train_size": "Train size", "roc_auc": "ROC AUC",
    "log_loss": "Log loss", "train_time": "Train time",
    "max_memory": "Maximum memory", "cpu_load": "CPU load",
}
