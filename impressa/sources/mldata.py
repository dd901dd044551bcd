"""ML datasets from LibSVM text (S4 hashed, S5 as-is) and from impressions.

The split, bucketing, hex rendering and md5 hashing are SQL expressions, and
vectors are built in the JVM.  ``repartition`` spreads rows over the
cluster's cores (M12); pass ``partitions=None`` to keep the scan's split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impressa.functions import encode, hashing, vectors
from impressa.functions.names import py_size_to_name
from impressa.schema import (
    ASIS_VECTOR_SIZE, CATEGORICAL_COLS, DEFAULT_HASH_SPACE, FEATURE_INDEX, NUMERIC_COLS,
)


def _parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.select(encode.parse_libsvm(column).alias("r")).select(
        F.col("r.label").alias("label"), F.col("r.features").alias("features"))


#: A label, then pairs of plain numbers: what the P1 writer makes.
PLAIN_LINE = r"[+-]?[0-9]{1,9}(?: [1-9][0-9]{0,8}:-?[0-9]{1,18})*+"


def _values(lines: DataFrame, column: str = "value") -> DataFrame:
    """LibSVM lines -> (label, kv): values by index, both as text, so that a plain line is split once by a built-in.

    Other lines go through ``parse_libsvm``, which tells empty, odd and malformed pairs apart.
    """
    pairs = F.transform(encode.parse_libsvm(column)["features"],
                        lambda t: F.struct(t["idx"].cast("string").alias("key"), t["val"].cast("string").alias("value")))
    rest = f"substr(`{column}`, instr(`{column}`, ' ') + 1)"
    plain = F.when(F.instr(F.col(column), " ") == 0, F.expr("CAST(map() AS MAP<STRING, STRING>)")).otherwise(F.expr(f"str_to_map({rest}, ' ', ':')"))
    return lines.select(F.split_part(F.col(column), F.lit(" "), F.lit(1)).cast("int").alias("label"),
                        F.when(F.col(column).rlike(f"^{PLAIN_LINE}$"), plain).otherwise(F.map_from_entries(pairs)).alias("kv"))


def _value_sql(c: str) -> str:
    return f"CAST(element_at(kv, '{FEATURE_INDEX[c]}') AS BIGINT)"


def impressions_from_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """LibSVM lines -> impression layout (label, i1..i13 BIGINT, c14..c39 hex text).

    Each index occurs at most once per line, so the parsed pairs become a map
    and every feature a flat ``element_at``: no nested lambda functions.
    """
    cols = [f"{_value_sql(c)} AS {c}" for c in NUMERIC_COLS]
    cols += [f"{encode.uint_to_hex8_sql(_value_sql(c))} AS {c}" for c in CATEGORICAL_COLS]
    return _values(lines, column).selectExpr("label", *cols)


def hashed_from_lines(lines: DataFrame, m: int = DEFAULT_HASH_SPACE, column: str = "value") -> DataFrame:
    """LibSVM lines -> (label DOUBLE, indices ARRAY<INT>): P4 -> P7..P11 in SQL.

    Values are numbers already, so categoricals are rendered (P8) straight into
    their tokens, without the check of their hex text.
    """
    numbers = _values(lines, column).selectExpr("label", *[f"{_value_sql(c)} AS {c}" for c in NUMERIC_COLS + CATEGORICAL_COLS])
    tokens = hashing.token_sql(categorical=[]) + [f"concat('{FEATURE_INDEX[c]}_', {encode.uint_to_hex8_sql(c)})" for c in CATEGORICAL_COLS]
    return hashing.with_hashed_indices(numbers, m, tokens=tokens).select(
        F.col("label").cast("double").alias("label"), "indices")


def load_ml_data(spark: SparkSession, template: str, sample: int, m: int = DEFAULT_HASH_SPACE,
                 partitions: int | None = None) -> DataFrame:
    """Hashed-vector dataset of sample ``sample`` (path = template with its name)."""
    lines = spark.read.text(template.format(py_size_to_name(sample)))
    df = vectors.with_binary_vector(hashed_from_lines(lines, m), "indices", m).select("label", "features")
    return df.repartition(partitions) if partitions else df


def load_ml_data_asis(spark: SparkSession, template: str, sample: int,
                      partitions: int | None = None) -> DataFrame:
    """As-is-vector dataset (size 40, index 0 unused) of sample ``sample``."""
    lines = spark.read.text(template.format(py_size_to_name(sample)))
    p = _parsed(lines)
    df = p.select(F.col("label").cast("double").alias("label"),
                  vectors.asis_vector("features", ASIS_VECTOR_SIZE).alias("features"))
    return df.repartition(partitions) if partitions else df


def hashed_dataset(rows: DataFrame, m: int = DEFAULT_HASH_SPACE, key: str = "event_id", indices: str = "indices") -> DataFrame:
    """(key, label DOUBLE, features) from rows that carry ``indices``."""
    rows = rows.select(key, F.col("label").cast("double").alias("label"), F.col(indices).alias("indices"))
    return vectors.with_binary_vector(rows, "indices", m).select(key, "label", "features")


def asis_dataset(imp: DataFrame, key: str = "event_id", *keep: str) -> DataFrame:
    """(key, *keep, label DOUBLE, features size 40) straight from impressions."""
    slot = {FEATURE_INDEX[c]: F.col(c) for c in NUMERIC_COLS}
    slot |= {FEATURE_INDEX[c]: encode.hex_to_uint(c) for c in CATEGORICAL_COLS}
    slots = [slot.get(i, F.lit(None)) for i in range(ASIS_VECTOR_SIZE)]
    return imp.select(key, *keep, F.col("label").cast("double").alias("label"),
                      vectors.slots_vector(slots).alias("features"))

