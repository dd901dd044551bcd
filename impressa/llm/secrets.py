"""Secret scan: keyword prefilter, anchored expressions, checksums (operator 3).

One Aho-Corasick pass over the folded text finds the keywords of all kinds;
an expression is matched only at a hit (anchored there), never searched for.
Hexadecimal runs have no keyword, so they are met by stride: a run of at least
n characters covers a position of every n, and only positions n-1, 2n-1, ...
that hold a digit are looked at and widened to their whole run.  Kinds with
an embedded checksum (two token families that end in six base-62 digits of a
CRC-32) are kept only if it is right.  Matching at ascending hits beyond the
last match gives the leftmost non-overlapping matches of each kind.

Scanning is a narrow pass: rows never move, whole texts are read.

Defined results: null text is empty; a text without secrets gives an empty
list; repeated rows and null ids are scanned like others; an empty table gives
no rows; other columns pass through.
"""

from __future__ import annotations

import hashlib
import re
from binascii import crc32
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The patterns of the three base kinds, their least lengths, and
# the prefixes of the checksummed tokens.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 8
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 16
HEX_LEAST = 32
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
CHECKED_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

#: Kinds in the order that ties at one start take.
KINDS = ("assign", "access", "hex", "checked")
BASE = KINDS[:3]

_FOLD = {i: i + 32 for i in range(65, 91)}
_HEX = re.compile("[0-9a-f]")
_HEX_RUN = re.compile("[0-9a-f]+")


def checksum_ok(body: str, check: str) -> bool:
    """Six base-62 digits, most significant first, of the body's CRC-32."""
    n, out = crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out == check


def _automaton():
    a = ahocorasick.Automaton()
    for kind, keys in (("assign", ASSIGN_WORDS), ("access", ("akia",)), ("checked", CHECKED_WORDS)):
        for w in keys:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


_PATTERN = {"assign": ASSIGN, "access": ACCESS, "checked": CHECKED}


def _fails(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) < ASSIGN_LEAST
    if kind == "access":
        return len(m[0]) < ACCESS_LEAST
    return not checksum_ok(m[1], m[2])


def _hex_spans(text: str) -> Iterator[tuple[int, int]]:
    end, step = 0, HEX_LEAST
    for hit in _HEX.finditer(text[step - 1::step]):
        at = hit.start() * step + step - 1
        if at < end:
            continue
        start = at
        while start > end and text[start - 1] in "0123456789abcdef":
            start -= 1
        end = _HEX_RUN.match(text, at).end()
        if end - start >= step:
            yield start, end


def spans(text: str, automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then kind in the order of KINDS."""
    low = text if text.isascii() and text.islower() else text.lower()
    if len(low) != len(text):
        low = text.translate(_FOLD)
    last = dict.fromkeys(_PATTERN, 0)
    starts = sorted({(end - n + 1, KINDS.index(kind)) for end, (kind, n) in automaton.iter(low)})
    out = []
    for at, k in starts:
        kind = KINDS[k]
        if at >= last[kind] and (m := _PATTERN[kind].match(text, at)):
            last[kind] = m.end()
            if not _fails(kind, m):
                out.append((at, k, m.end()))
    out += [(a, KINDS.index("hex"), b) for a, b in _hex_spans(text)]
    return [(a, b, KINDS[k]) for a, k, b in sorted(out)]


def scan(docs: DataFrame, text: str = "text", name: str = "secrets") -> DataFrame:
    """``docs`` with ``name``: array of (kind, start, end, secret)."""

    @F.pandas_udf("array<struct<kind: string, start: int, end: int, secret: string>>")
    def find(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a = _automaton()
        for p in parts:
            yield pd.Series([[{"kind": k, "start": s, "end": e, "secret": x[s:e]} for s, e, k in spans(x, a)] if x else []
                             for x in p], dtype=object)

    return docs.withColumn(name, find(F.coalesce(F.col(text), F.lit(""))))


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span (overlaps merged) replaced by ``mask``; same columns, null text stays null."""

    @F.pandas_udf("string")
    def cut(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a = _automaton()
        for p in parts:
            out = []
            for x in p:
                if x is not None:
                    got, at = [], 0
                    for s, e, _ in spans(x, a):
                        if s >= at:
                            got += [x[at:s], mask]
                        at = max(at, e)
                    x = "".join([*got, x[at:]])
                out.append(x)
            yield pd.Series(out, dtype=object)

    return docs.withColumn(text, cut(F.col(text)))


def query(docs: DataFrame) -> DataFrame:
    """The contract's digest columns, from the operator's spans."""
    found = scan(docs.select("doc_id", "text"))

    def count(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(arr):
        return F.array_join(F.transform(arr, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
                        listed(F.col("secrets")).alias("spans"), count("checked"))
