"""Sample size <-> short "engineering" name (10000 -> 10k, 3e9 -> 3kkk).

Every group of three zeros, counted from the right as the text is read
backwards, becomes one ``k``: 10003000 is 1k3k.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def size_to_name(n) -> Column:
    """The size's digits with every ``000`` (found from the right) as ``k``."""
    s = (F.col(n) if isinstance(n, str) else n).cast("string")
    return F.reverse(F.replace(F.reverse(s), F.lit("000"), F.lit("k")))


def name_to_size(s) -> Column:
    """Inverse of ``size_to_name``; 0 when the text is not a size."""
    s = F.col(s) if isinstance(s, str) else s
    return F.coalesce(F.replace(s, F.lit("k"), F.lit("000")).try_cast("bigint"),
                      F.lit(0).cast("bigint"))


def py_size_to_name(n: int) -> str:
    return str(n)[::-1].replace("000", "k")[::-1]


def py_name_to_size(s: str) -> int:
    """Inverse of ``py_size_to_name``; 0 when the text is not a size."""
    digits = s.replace("k", "000")
    return int(digits) if digits.isdecimal() else 0


def ladder(first_exp: int = 4, last_exp: int = 9) -> list[int]:
    """Sample ladder 1*10^k, 3*10^k for k = first_exp..last_exp."""
    out = []
    for k in range(first_exp, last_exp + 1):
        out += [10 ** k, 3 * 10 ** k]
    return out
