"""Feature tokens and the bit-compatible MD5 feature hash.

The hash of token ``t`` is the first 8 bytes of ``md5(t)`` read as an unsigned
little-endian 64-bit integer, modulo the hash-space size ``m``.  Spark has no
unsigned 64-bit type, so the value is split into two 32-bit halves and reduced
as ``((hi % m) * (2^32 % m) + lo % m) % m``, which stays inside BIGINT for
``m < 3e9``.  Row-wise hashing uses flat projections only: nested lambda
functions are interpreted (no codegen) and costly for Catalyst to canonicalize.
"""

from __future__ import annotations

import binascii

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from impressa.functions.encode import HEX32, log_square_sql
from impressa.schema import CATEGORICAL_COLS, DEFAULT_HASH_SPACE, FEATURE_INDEX, NUMERIC_COLS

MAX_HASH_SPACE = 3_000_000_000


def _check_m(m: int) -> int:
    m = int(m)
    if not 1 <= m < MAX_HASH_SPACE:
        raise ValueError(f"hash space must be in [1, {MAX_HASH_SPACE}), got {m}")
    return m


def md5_hex(c) -> Column:
    """md5 hex of a value's string form."""
    c = F.col(c) if isinstance(c, str) else c
    return F.md5(c.cast("string"))


def _be_word_sql(h: str, first_byte: int) -> str:
    # digest bytes first_byte..first_byte+3 read big-endian (hex text order)
    return f"CAST(conv(substr({h}, {2 * first_byte + 1}, 8), 16, 10) AS BIGINT)"


def _bswap32_sql(w: str) -> str:
    return (f"(shiftleft({w} & 255, 24) | shiftleft(shiftright({w}, 8) & 255, 16) | "
            f"shiftleft(shiftright({w}, 16) & 255, 8) | (shiftright({w}, 24) & 255))")


def words_to_index_sql(w0: str, w1: str, m: int) -> str:
    """Index from the two big-endian digest words (bytes 0-3, 4-7)."""
    m = _check_m(m)
    lo, hi = _bswap32_sql(w0), _bswap32_sql(w1)
    return f"CAST((({hi} % {m}) * {(1 << 32) % m} + {lo} % {m}) % {m} AS INT)"


def digest_to_index_sql(h: str, m: int) -> str:
    return words_to_index_sql(_be_word_sql(h, 0), _be_word_sql(h, 4), m)


def hash_index(token: str, m: int = DEFAULT_HASH_SPACE) -> Column:
    """P10: token column (by name) -> index in [0, m).

    The digest appears in eight slices; whole-stage codegen's common
    subexpression elimination computes it once.
    """
    return F.expr(digest_to_index_sql(f"md5(`{token}`)", m))


def token_sql(numeric=NUMERIC_COLS, categorical=CATEGORICAL_COLS) -> list[str]:
    """One ``idx_value`` token per feature, as SQL text (null for a null feature).

    Numerics are log-square bucketed; categoricals are rendered as 8-digit
    lowercase hex of their parsed value (malformed hex -> null token).
    """
    toks = [f"concat('{FEATURE_INDEX[c]}_', CAST({log_square_sql(c)} AS STRING))" for c in numeric]
    # for hex that passes the check, lpad(lower(c)) equals hex8 of the parsed value
    toks += [f"CASE WHEN {c} RLIKE '{HEX32}' THEN concat('{FEATURE_INDEX[c]}_', lpad(lower({c}), 8, '0')) END"
             for c in categorical]
    return toks


def feature_tokens(numeric=NUMERIC_COLS, categorical=CATEGORICAL_COLS) -> Column:
    """ARRAY<STRING> of the 39 tokens (nulls kept, position = feature index - 1)."""
    return F.expr("array(" + ", ".join(token_sql(numeric, categorical)) + ")")


def with_hashed_indices(df: DataFrame, m: int = DEFAULT_HASH_SPACE, out: str = "indices",
                        tokens: list[str] | None = None) -> DataFrame:
    """P10+P11: add ``out`` = strictly ascending distinct ARRAY<INT> of token hashes.

    Flat projections and no lambda functions: one md5 digest column per
    token, then its two 32-bit words, then the index from the byte-swapped
    words.  ``array_except`` against ``[NULL]`` drops null tokens and
    duplicates and ``sort_array`` orders the result; both have generated code
    (``array_compact`` and comparator-free ``array_sort`` are lambda functions,
    which would evaluate the whole index expression interpreted).  Catalyst
    keeps the digest projection apart from the rest (it does not duplicate
    non-cheap expressions such as md5 when collapsing), so each digest is
    computed once.  Together with the impression projection of the same stage
    the generated method exceeds the JVM's 64 KB limit; Spark then runs the
    stage with per-expression generated code, still faster than the
    interpreted path (see README, Open work).
    """
    return with_hash_spaces(df, {out: m}, tokens)


def with_hash_spaces(df: DataFrame, spaces: dict[str, int], tokens: list[str] | None = None) -> DataFrame:
    """``with_hashed_indices`` for several hash spaces, {column: m}, from one digest a token."""
    toks = token_sql() if tokens is None else tokens
    dn = [f"_d{k}" for k in range(len(toks))]
    digests = df.selectExpr("*", *[f"md5({t}) AS {n}" for t, n in zip(toks, dn)])
    words = digests.selectExpr(*[f"`{c}`" for c in df.columns],
                               *[f"{_be_word_sql(n, 0)} AS {n}a" for n in dn],
                               *[f"{_be_word_sql(n, 4)} AS {n}b" for n in dn])
    keep = [f"`{c}`" for c in df.columns]
    idx = {out: "array(" + ", ".join(words_to_index_sql(f"{n}a", f"{n}b", m) for n in dn) + ")" for out, m in spaces.items()}
    return words.selectExpr(*keep, *[f"sort_array(array_except({i}, array(CAST(NULL AS INT)))) AS `{out}`" for out, i in idx.items()])


ABSENT = "z" * 16


def _indices(text, tokens: int, spaces: list[int]):
    """Index lists of every space from an Arrow column of ``tokens`` times 16 digits, ``ABSENT`` for a null token."""
    import pyarrow as pa

    n, size = len(text), 16 * tokens
    first = np.frombuffer(text.buffers()[1], np.int32)[text.offset]
    digits = np.frombuffer(text.buffers()[2], np.uint8, n * size, first).reshape(n, tokens, 16).copy()
    absent = digits[:, :, 0] == ord(ABSENT[0])
    digits[absent] = ord("0")
    values = np.frombuffer(binascii.unhexlify(digits.tobytes()), "<u8").reshape(n, tokens)
    for m in spaces:
        idx = np.sort(np.where(absent, -1, (values % np.uint64(m)).astype(np.int64)), axis=1)
        own = idx >= 0
        own[:, 1:] &= idx[:, 1:] != idx[:, :-1]
        ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(own.sum(axis=1), dtype=np.int32)])
        yield pa.ListArray.from_arrays(pa.array(ends), pa.array(idx[own].astype(np.int32)))


def packed_hash_spaces(df: DataFrame, spaces: dict[str, int], *keep: str, tokens: list[str] | None = None) -> DataFrame:
    """(*keep, and the columns of ``with_hash_spaces``), from one text of digests a row, reduced and sorted in arrays.

    For several spaces: as JVM expressions, the projections of two spaces take longer than those of one space, twice.
    """
    toks, sizes = token_sql() if tokens is None else tokens, [_check_m(m) for m in spaces.values()]
    if max(sizes) > 1 << 31:
        raise ValueError(f"an index of {max(sizes)} is no INT")
    digits = df.selectExpr(*keep, "concat(" + ", ".join(f"coalesce(substr(md5({t}), 1, 16), '{ABSENT}')" for t in toks) + ") AS _digits")
    kept = digits.select(*keep).schema

    def hashed(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                columns = [batch.column(c) for c in keep] + list(_indices(batch.column("_digits"), len(toks), sizes))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *spaces])

    return digits.mapInArrow(hashed, StructType([*kept.fields, *(StructField(c, ArrayType(IntegerType(), False)) for c in spaces)]))


# ---------------------------------------------------------------- fast mode of P10 (not bit-compatible with the MD5 hash)

FAST_PRIME = (1 << 31) - 1


def fast_factors(feature: int) -> tuple[int, int, int]:
    """Multipliers of the low and high part of a value, and the offset, of one feature: a fixed walk through the residues of the prime."""
    out, x = [], 48271 * (feature + 1)
    for _ in range(3):
        for _ in range(7):
            x = x * 48271 % FAST_PRIME
        out.append(x)
    return out[0], out[1], out[2]


def fast_index_sql(feature: int, value: str, m: int) -> str:
    """Index in [0, m) of an integer value of a feature, null for null: integer arithmetic alone, no text and no digest.

    The value splits into its remainder and quotient by the prime; each is
    under 2^33, so the products stay inside BIGINT.
    """
    a, b, c = fast_factors(feature)
    p = FAST_PRIME
    mixed = f"(pmod({value}, {p}L) * {a}L + pmod(floor({value} / {p}L), {p}L) * {b}L % {p}L + {c}L) % {p}L"
    return f"CAST({mixed} * {a}L % {p}L % {_check_m(m)}L AS INT)"


def with_fast_indices(df: DataFrame, m: int = DEFAULT_HASH_SPACE, out: str = "indices") -> DataFrame:
    """P10 fast mode + P11: ascending distinct indices of (feature, value), values bucketed as in P7 and parsed as in P3.

    As good a spread over the hash space as P10, but other indices.
    """
    values = [(FEATURE_INDEX[c], log_square_sql(c)) for c in NUMERIC_COLS]
    values += [(FEATURE_INDEX[c], f"CASE WHEN {c} RLIKE '{HEX32}' THEN CAST(conv({c}, 16, 10) AS BIGINT) END") for c in CATEGORICAL_COLS]
    named = df.selectExpr("*", *[f"{v} AS _v{k}" for k, v in values])
    idx = "array(" + ", ".join(fast_index_sql(k, f"_v{k}", m) for k, _ in values) + ")"
    return named.selectExpr(*[f"`{c}`" for c in df.columns], f"sort_array(array_except({idx}, array(CAST(NULL AS INT)))) AS `{out}`")
