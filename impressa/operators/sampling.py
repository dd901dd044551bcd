"""Hold-out split and deterministic sampling.

Sampling is a salted hash of a unique key: ``h = md5(salt || ':' || key)``.
A Bernoulli sample keeps rows with ``h`` below a threshold; an exact sample of
n rows keeps the n smallest ``(h, key)``.  Both are pure functions of the
row, so they are repeatable, survive recomputation after executor loss, and
have no positional bias.  Sizes salted by their own name are independent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from impressa.sources.sinks import stage

PREFIX_DIGITS = 13              # 52 bits: exact in a double
PREFIX_RANGE = 1 << (4 * PREFIX_DIGITS)


def sample_hash(key, salt: str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{salt}:"), key.cast("string")))


def hash_prefix(h: Column) -> Column:
    return F.conv(F.substring(h, 1, PREFIX_DIGITS), 16, 10).cast("bigint")


def holdout_split(df: DataFrame, day: str = "day", last_day: int | None = None
                  ) -> tuple[DataFrame, DataFrame]:
    """(train = days before the last, test = the last day)."""
    if last_day is None:
        last_day = df.agg(F.max(day)).first()[0]
    return df.filter(F.col(day) < last_day), df.filter(F.col(day) == last_day)


def bernoulli_sample(df: DataFrame, key: str, fraction: float, salt: str) -> DataFrame:
    """Keep each row with probability ``fraction`` (hash threshold, no shuffle)."""
    fraction = min(1.0, max(0.0, float(fraction)))
    cut = int(fraction * PREFIX_RANGE)
    return df.filter(hash_prefix(sample_hash(key, salt)) < F.lit(cut))


def _strict_hash(key: str, salt: str) -> Column:
    return F.coalesce(sample_hash(key, salt), F.raise_error(F.lit(f"null sampling key {key}")).cast("string"))


class SampleShort(RuntimeError):
    pass


ROWS_A_BUCKET = 100_000


def _smallest(kept: DataFrame, key: str, n: int, below: int) -> DataFrame | None:
    """The n rows of smallest (_h, key) among staged rows with hash prefixes ``_hp`` under ``below``; None if they are fewer.

    A prefix is uniform, so equal parts of its span are buckets of about equal
    size, in order, without a shuffle or a sample of bounds.  One count a
    bucket tells which buckets pass whole and which one holds the n-th row;
    only that one is ranked.
    """
    width = -(-below // max(1, n // ROWS_A_BUCKET))
    bucketed = kept.withColumn("_bucket", F.floor(F.col("_hp") / F.lit(width)).cast("bigint"))
    counts, before, last = sorted(bucketed.groupBy("_bucket").count().collect()), 0, None
    for bucket, rows in counts:
        if before + rows >= n:
            last = bucket
            break
        before += rows
    if last is None:
        return None
    whole = bucketed.where(F.col("_bucket") < last)
    w = Window.partitionBy("_bucket").orderBy("_h", key)
    part = bucketed.where(F.col("_bucket") == last).withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= n - before)
    return (part.drop("_nth") if not before else whole.unionByName(part.drop("_nth"))).drop("_bucket")


def exact_sample(df: DataFrame, key: str, n: int, salt: str, total: int | None = None,
                 oversample: float = 1.03) -> DataFrame:
    """R2: exactly min(n, N) rows: the n smallest (md5(salt:key), key).

    A Bernoulli pre-filter at ``oversample * n / N`` trims the input without a
    shuffle, and what it keeps is staged, so the input is read once for the
    count and once for the rows; if fewer than n rows are kept the threshold
    doubles until n are.  The cut inside the kept rows counts buckets of the
    hash.  Null keys have no place in the order: reading one raises, and so
    does a sample that comes out short.
    """
    n = int(n)
    total = df.count() if total is None else int(total)
    if n <= 0:
        return df.limit(0)
    if n >= total:
        return df
    hashed = df.withColumn("_h", _strict_hash(key, salt)).withColumn("_hp", hash_prefix(F.col("_h")))
    frac = min(1.0, oversample * n / total)
    while True:
        below = int(frac * PREFIX_RANGE)
        kept = stage(hashed.filter(F.col("_hp") < F.lit(below)), "sample-kept")
        cut = _smallest(kept, key, n, below)
        if cut is not None:
            return cut.drop("_h", "_hp")
        if frac >= 1.0:
            raise SampleShort(f"under {n} of {total} rows asked for")
        frac = min(1.0, frac * 2)


def exact_samples(df: DataFrame, key: str, sizes: dict[str, int], total: int | None = None,
                  oversample: float = 1.03) -> dict[str, DataFrame]:
    """R2 for many named sizes with one scan of ``df``, each as ``exact_sample(df, key, n, salt=name)``.

    The scan stages a row once for every size whose pre-filter it passes; each
    size is then cut from its own staged rows.  A size of all rows is
    ``df`` itself; one whose pre-filter kept too few rows is drawn alone.
    """
    total = df.count() if total is None else int(total)
    below = {s: int(min(1.0, oversample * n / total) * PREFIX_RANGE) for s, n in sizes.items() if 0 < n < total}
    out = {s: df if n >= total else df.limit(0) for s, n in sizes.items() if s not in below}
    if not below:
        return out
    tags = [F.when(hash_prefix(_strict_hash(key, s)) < F.lit(b), F.lit(s)) for s, b in below.items()]
    near = stage(df.withColumn("_sample", F.explode(F.array_compact(F.array(*tags)))), "samples", partition_by="_sample")
    near = near.withColumn("_sample", F.col("_sample").cast("string"))
    for s, b in below.items():
        kept = near.where(F.col("_sample") == s).drop("_sample").withColumn("_h", sample_hash(key, s))
        cut = _smallest(kept.withColumn("_hp", hash_prefix(F.col("_h"))), key, sizes[s], b)
        out[s] = exact_sample(df, key, sizes[s], s, total, 2 * oversample) if cut is None else cut.drop("_h", "_hp")
    return out


def sample_members(df: DataFrame, key: str, sizes: dict[str, int], row: str, total: int) -> dict[str, Column]:
    """R2 for many named sizes as conditions on the rows of ``df``: who is among the n smallest (md5(name:key), key, ``row``).

    ``df`` is staged and ``row`` a number of its rows, unique, that settles
    equal keys.  One scan counts rows a bucket of each size's hash, a second one
    ranks the bucket that holds the n-th row; no row is written or moved.
    """
    out = {s: F.lit(n >= total) for s, n in sizes.items()}
    inside = {s: int(n) for s, n in sizes.items() if 0 < n < total}
    if not inside:
        return out
    width = -(-PREFIX_RANGE // max(1, total // ROWS_A_BUCKET))

    def bucket(s: str) -> Column:
        return F.floor(hash_prefix(_strict_hash(key, s)) / F.lit(width)).cast("bigint")

    names = list(inside)
    placed = df.select(F.posexplode(F.array(*[bucket(s) for s in names])).alias("_s", "_bucket"))
    counts: dict[str, list] = {s: [] for s in names}
    for r in placed.groupBy("_s", "_bucket").count().collect():
        counts[names[r["_s"]]].append((r["_bucket"], r["count"]))
    last, nth = {}, {}
    for s, n in inside.items():
        before = 0
        for b, rows in sorted(counts[s]):
            if before + rows >= n:
                last[s], nth[s] = b, n - before
                break
            before += rows
        else:
            raise SampleShort(f"under {n} of {total} rows asked for")
    near = F.array(*[F.when(bucket(s) == last[s], F.struct(F.lit(s).alias("s"), sample_hash(key, s).alias("h"), F.col(key).alias("key"), F.col(row).alias("row")))
                     for s in names])
    ranked = df.select(F.explode(F.array_compact(near)).alias("r")).select("r.*")
    w = Window.partitionBy("s").orderBy("h", "key", "row")
    want = F.coalesce(*[F.when(F.col("s") == s, F.lit(n)) for s, n in nth.items()])
    for r in ranked.withColumn("nth", F.row_number().over(w)).where(F.col("nth") == want).collect():
        h = sample_hash(key, r["s"])
        tied = (F.col(key) < r["key"]) | ((F.col(key) == r["key"]) & (F.col(row) <= r["row"]))
        out[r["s"]] = (h < r["h"]) | ((h == r["h"]) & tied)
    return out


def count_per_day(df: DataFrame, day: str = "day") -> DataFrame:
    """A2: rows per day plus the total (``rollup``: the total row has day null)."""
    return df.rollup(day).agg(F.count(F.lit(1)).alias("n_rows"))
