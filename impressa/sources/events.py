"""Impressions derived from the driver's ``events`` table.

The given tables hold no click log, so impressions are built from ``events``
(unique ``event_id``, 30 days).  Two labels: ``label_click`` (event type is a
click, no signal) and ``label`` (deterministic, depends on ``k`` and the hour,
so it is learnable).  Everything is a narrow projection: no shuffle, and
Catalyst prunes ``events`` to the six columns used.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impressa.schema import CATEGORICAL_COLS, NUMERIC_COLS

# Fixed values of the adapter: the epoch of day 0, the categoricals that get
# nulls and the label thresholds (per mille).
EPOCH = "2024-01-01"
NULLABLE_CATEGORICALS = (18, 24, 30, 36)
LABEL_BASE, LABEL_K_BONUS, LABEL_NIGHT_BONUS = 50, 400, 200


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _md5_hex(prefix: str, src: str, digits: int) -> str:
    return f"substr(md5(concat('{prefix}', CAST({src} AS STRING))), 1, {digits})"


DAY_SQL = f"CAST(datediff(to_date(ts), DATE'{EPOCH}') AS INT)"


def impressions_from_events(events: DataFrame, *keep: str) -> DataFrame:
    """events -> (event_id, day, label_click, label, i1..i13, c14..c39, *keep).

    Two ``selectExpr`` projections (Catalyst collapses them into one).
    """
    base = events.selectExpr(
        "CAST(event_id AS BIGINT) AS event_id", "ts",
        "CAST(user_id AS BIGINT) AS user_id", "event_type",
        "CAST(value AS DOUBLE) AS value",
        "CAST(get_json_object(props, '$.k') AS BIGINT) AS k",
        "CAST(hour(ts) AS BIGINT) AS hr", *keep,
    )
    u = f"CAST(conv({_md5_hex('y_', 'event_id', 7)}, 16, 10) AS BIGINT)"
    thr = (f"({LABEL_BASE} + CASE WHEN k >= 50 THEN {LABEL_K_BONUS} ELSE 0 END"
           f" + CASE WHEN hr < 6 THEN {LABEL_NIGHT_BONUS} ELSE 0 END)")
    numeric = {
        "i1": "floor(value)",
        "i2": "user_id - 3",
        "i3": "hr",
        "i4": "minute(ts)",
        "i5": "second(ts)",
        "i6": "k",
        "i7": "k * k",
        "i8": "user_id * 37",
        "i9": "floor(value * 100)",
        "i10": "CASE WHEN k % 5 <> 0 THEN k - 2 END",
        "i11": "CASE WHEN user_id % 7 <> 0 THEN user_id * user_id END",
        "i12": "event_id % 11",
        "i13": "dayofmonth(ts)",
    }
    sources = {0: "user_id", 1: "k", 2: "hr", 3: "(event_id % 1000)"}
    cats = []
    for name in CATEGORICAL_COLS:
        i = int(name[1:])
        c = _md5_hex(f"c{i}_", sources[i % 4], 8)
        if i in NULLABLE_CATEGORICALS:
            c = f"CASE WHEN k % {i - 9} <> 0 THEN {c} END"
        cats.append(f"{c} AS {name}")
    return base.selectExpr(
        "event_id",
        f"{DAY_SQL} AS day",
        "CAST(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS INT) AS label_click",
        f"CAST(CASE WHEN {u} % 1000 < {thr} THEN 1 ELSE 0 END AS INT) AS label",
        *[f"CAST({numeric[c]} AS BIGINT) AS {c}" for c in NUMERIC_COLS],
        *cats, *keep,
    )


ROWS_A_TASK = 250_000


def tasks_for(spark: SparkSession, rows: int, rows_a_task: int = ROWS_A_TASK) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-rows // rows_a_task))


def task_count(df: DataFrame, rows_a_task: int = ROWS_A_TASK) -> int:
    return tasks_for(df.sparkSession, df.count(), rows_a_task)


def spread(df: DataFrame, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """Tasks of at most about ``rows_a_task`` rows, and one for every core at least.

    A narrow row becomes 39 features, so the row-wise encoders take much CPU
    and memory for each byte read: splits of a scan, cut by bytes and by row
    groups, are too few and uneven.  The rows are dealt round-robin while they
    are narrow; a table with enough splits is left alone.
    """
    tasks = task_count(df, rows_a_task)
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def load_impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impressions_from_events(spread(read_table(spark, sf_dir, "events")))



def impressions_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impressions in ascending (day, event_id) over the partitions and within them.

    Events are ordered before they are encoded, while a row is narrow; a day may be cut over several tasks.
    """
    events = read_table(spark, sf_dir, "events").withColumn("_day", F.expr(DAY_SQL))
    at = ["_day", "event_id"]
    placed = events.repartitionByRange(task_count(events), *at).sortWithinPartitions(*at)
    return impressions_from_events(placed, "_day").drop("day").withColumnRenamed("_day", "day")
