"""Column expressions for the sparse text encodings (LibSVM, VW).

All builders return ``Column`` objects made of built-in functions, so they run
inside whole-stage codegen; none needs a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from impressa.schema import CATEGORICAL_COLS, FEATURE_INDEX, FIRST_CATEGORICAL, NUMERIC_COLS

HEX32 = r"^[0-9A-Fa-f]{1,8}$"


# SQL-text builders.  Bulk projections (39 features per row) are passed to
# ``selectExpr`` as text: one py4j call per projection instead of one per
# function node, which otherwise dominates the cost of building the plan.

def hex_to_uint_sql(c: str) -> str:
    return f"CASE WHEN {c} RLIKE '{HEX32}' THEN CAST(conv({c}, 16, 10) AS BIGINT) END"


def strict_hex_to_uint_sql(c: str) -> str:
    """As ``hex_to_uint_sql``, but malformed text raises."""
    return (f"CASE WHEN {c} IS NULL THEN NULL WHEN {c} RLIKE '{HEX32}' THEN CAST(conv({c}, 16, 10) AS BIGINT) "
            f"ELSE CAST(raise_error(concat('malformed hex: ', {c})) AS BIGINT) END")


def uint_to_hex8_sql(v: str) -> str:
    return f"lpad(lower(hex({v})), 8, '0')"


def log_square_sql(c: str) -> str:
    return f"CAST(CASE WHEN {c} > 2 THEN floor(pow(ln({c}), 2)) ELSE {c} END AS BIGINT)"


def libsvm_line_sql(label: str = "label", numeric=NUMERIC_COLS, categorical=CATEGORICAL_COLS) -> str:
    parts = [f"coalesce(CAST({label} AS STRING), CAST(raise_error('null label') AS STRING))"]
    parts += [f"concat('{FEATURE_INDEX[c]}:', CAST({c} AS STRING))" for c in numeric]
    parts += [f"concat('{FEATURE_INDEX[c]}:', CAST({strict_hex_to_uint_sql(c)} AS STRING))"
              for c in categorical]
    return "concat_ws(' ', " + ", ".join(parts) + ")"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hex_to_uint(c, strict: bool = False) -> Column:
    """Hex text of a 32-bit hash -> unsigned value (0..2^32-1) as BIGINT.

    ``conv`` alone turns malformed text into 0; here malformed text becomes
    null (default) or raises (``strict``), never 0.
    """
    if isinstance(c, str) and not strict:
        return F.expr(hex_to_uint_sql(c))
    c = _col(c)
    ok = c.rlike(HEX32)
    parsed = F.conv(c, 16, 10).cast("bigint")
    if strict:
        return F.when(c.isNull(), F.lit(None).cast("bigint")).when(ok, parsed).otherwise(
            F.raise_error(F.concat(F.lit("malformed hex: "), c)).cast("bigint"))
    return F.when(ok, parsed)


def uint_to_hex8(v) -> Column:
    """Unsigned value -> lowercase zero-padded 8-digit hex."""
    return F.lpad(F.lower(F.hex(_col(v))), 8, "0")


def log_square_bucket(v) -> Column:
    """V -> floor(ln(v)^2) for v > 2, else v unchanged (negatives too)."""
    if isinstance(v, str):
        return F.expr(log_square_sql(v))
    v = _col(v)
    return F.when(v > 2, F.floor(F.pow(F.log(v), 2))).otherwise(v).cast("bigint")


def libsvm_pairs(numeric=NUMERIC_COLS, categorical=CATEGORICAL_COLS) -> list[Column]:
    """P1/P2 pieces: ``idx:value`` per feature, null when the feature is null."""
    out = []
    for c in numeric:
        out.append(F.concat(F.lit(f"{FEATURE_INDEX[c]}:"), F.col(c).cast("string")))
    for c in categorical:
        out.append(F.concat(F.lit(f"{FEATURE_INDEX[c]}:"), hex_to_uint(c, strict=True).cast("string")))
    return out


def libsvm_line(label="label", numeric=NUMERIC_COLS, categorical=CATEGORICAL_COLS) -> Column:
    """Impression row -> ``label idx:value ...`` (nulls omitted, no trailing space).

    A null label or malformed hex raises.

    ``concat`` is null when its input is null and ``concat_ws`` skips nulls, so
    null features drop out without a branch per column.
    """
    if isinstance(label, str):
        return F.expr(libsvm_line_sql(label, numeric, categorical))
    head = F.coalesce(_col(label).cast("string"), F.raise_error(F.lit("null label")).cast("string"))
    return F.concat_ws(" ", head, *libsvm_pairs(numeric, categorical))


def vw_label(label) -> Column:
    """Label text '1' -> 1, anything else -> -1."""
    return F.when(_col(label).cast("string") == "1", F.lit(1)).otherwise(F.lit(-1))


def vw_line(line="value") -> Column:
    """P5: LibSVM line -> VW line ``±1 | idx:v ... idx_v`` (idx >= 14 as names)."""
    parts = F.split(_col(line), " ")
    feats = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    renamed = F.transform(
        feats,
        lambda t: F.when(
            F.split_part(t, F.lit(":"), F.lit(1)).cast("int") >= FIRST_CATEGORICAL,
            F.regexp_replace(t, ":", "_"),
        ).otherwise(t),
    )
    head = F.concat(vw_label(F.element_at(parts, 1)).cast("string"), F.lit(" |"))
    return F.array_join(F.concat(F.array(head), renamed), " ")


def parse_libsvm(line="value") -> Column:
    """LibSVM line -> struct(label INT, features ARRAY<STRUCT<idx INT, val BIGINT>>)."""
    text = _col(line)

    def pairs(parts):
        feats = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda t: t != "")
        return F.transform(
            feats,
            lambda t: F.struct(
                F.split_part(t, F.lit(":"), F.lit(1)).cast("int").alias("idx"),
                F.split_part(t, F.lit(":"), F.lit(2)).cast("bigint").alias("val"),
            ),
        )

    # the array of one entry names the split, which is made once
    features = F.get(F.transform(F.array(F.split(text, " ")), pairs), F.lit(0))
    return F.struct(F.split_part(text, F.lit(" "), F.lit(1)).cast("int").alias("label"), features.alias("features"))
