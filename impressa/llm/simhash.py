"""SimHash near-duplicates by meet-in-the-middle ball hashing (operator 8).

Fingerprint: XXH64 (seed 42) of every k-word shingle, repeats included; a bit
is 1 if it is set in more than half of the hashes.  Fewer than k words: the
whole sequence is the one shingle.  No words: fingerprint zero.

Two fingerprints at distance <= r share a variant that is within r/2 bits of
both, so every distinct fingerprint emits its whole ball of radius r/2 (2081
variants for r = 4) and fingerprints that meet on a variant are joined.

The shuffle on variants is sent in packed form.  A linear hash over GF(2)
gives hash(fp ^ mask) = hash(fp) ^ hash(mask), so "all variants of fp in
bucket t" needs no list: the fingerprint itself goes to bucket t, and the task
there regenerates exactly the variants with that hash.  A fingerprint costs 8
bytes a bucket instead of a row for each of its variants, and every variant is
made once over all buckets.  Variants spread evenly whatever the fingerprints
are: exact copies are one fingerprint, near copies differ in their variants,
and a variant belongs to at most 2081 distinct fingerprints, so no key is hot.
The number of buckets grows with the input and bounds the variants of a bucket.

Within a bucket every run of equal variants is a star around its smallest
inner fingerprint, each link's bit distance is checked, and the bucket
returns one root per linked fingerprint (never pairs).  Components follow over
distinct fingerprints by ``connected_components``.

Defined results: null text is empty; null ids keep their rows and never name a
component (null if all ids of a component are null); repeated rows are rows of
one component; an empty table gives no rows; other columns pass through
untouched.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impressa.llm.common import KEY, doc_key, run_labels, shuffle_partitions, text_bytes, words
from impressa.llm.components import connected_components
from impressa.sources.sinks import stage

SEED = 42
#: Variants that one bucket holds, on average, at most.
BUCKET_VARIANTS = 1 << 22
#: Fingerprints times their buckets that are dealt at once.
DEAL = 1 << 22


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 of each k-word shingle, words joined by one space."""
    w = words(text)
    if not w:
        return np.empty(0, np.uint64)
    if len(w) <= k:
        grams = [b" ".join(w)]
    else:
        grams = map(b" ".join, zip(*(w[i:] for i in range(k))))
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, grams, repeat(SEED))), ">u8").astype(np.uint64)


def fingerprint(text: bytes, k: int, block: int = 1 << 16) -> int:
    h = shingle_hashes(text, k)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), block):
        ones += np.unpackbits(h[i:i + block].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, k: int, keep: list[str]) -> DataFrame:
    """``keep`` columns and fp (the 64 bits as a signed long); ``docs`` has the bytes in ``text``."""
    cols = docs.select(*keep, "text")
    schema = cols.drop("text").withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(x, k) for x in b.column("text").to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(fp.view(np.int64))], [*keep, "fp"])

    return cols.mapInArrow(run, schema)


class Ball:
    """The masks of a ball, and the linear hash that deals variants to 2^bits buckets."""

    def __init__(self, radius: int, bits: int):
        half = (radius + 1) // 2
        masks = [sum(1 << i for i in c) for n in range(half + 1) for c in combinations(range(64), n)]
        self.masks = np.array(masks, np.uint64)
        self.inner = np.array([m.bit_count() <= radius // 2 for m in masks])
        self.radius, self.n = radius, 1 << bits
        rng = np.random.default_rng(20240607)
        basis = rng.integers(0, self.n, 64, dtype=np.int64)
        self.byte = np.zeros((8, 256), np.int64)
        for i in range(8):
            for v in range(256):
                for j in range(8):
                    if v >> j & 1:
                        self.byte[i, v] ^= basis[8 * i + j]
        order = np.argsort(self.hash(self.masks), kind="stable")
        self.masks, self.inner = self.masks[order], self.inner[order]
        self.count = np.bincount(self.hash(self.masks), minlength=self.n)
        self.start = np.concatenate(([0], np.cumsum(self.count)[:-1]))
        self.used = np.flatnonzero(self.count)

    def hash(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for i in range(8):
            out ^= self.byte[i, (x >> np.uint64(8 * i) & np.uint64(255)).astype(np.int64)]
        return out

    def deal(self, fps: np.ndarray):
        """(buckets, first position of each, fingerprints by bucket), in bounded pieces.

        The cost is a fingerprint's own buckets, at most one a mask, however many there are.
        """
        step = max(1, DEAL // len(self.used))
        for i in range(0, len(fps), step):
            part = fps[i:i + step]
            t = (self.hash(part)[:, None] ^ self.used).ravel()
            order = np.argsort(t, kind="stable")
            t = t[order]
            at = np.flatnonzero(np.diff(t, prepend=-1))
            yield t[at], at, part[order // len(self.used)]

    def variants(self, fps: np.ndarray, bucket: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the fingerprint, variant, and whether it is within the inner radius."""
        h = self.hash(fps) ^ bucket
        n = self.count[h]
        who = np.repeat(np.arange(len(fps)), n)
        at = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[h], n)
        return who, fps[who] ^ self.masks[at], self.inner[at]

    def roots(self, fps: np.ndarray, bucket: int) -> tuple[np.ndarray, np.ndarray]:
        """Linked fingerprints of a bucket and a root for each."""
        who, var, inner = self.variants(fps, bucket)
        s = np.sort(var)
        twice = s[1:][s[1:] == s[:-1]]
        if not len(twice):
            return fps[:0], fps[:0]
        twice = np.unique(twice)
        pos = np.minimum(np.searchsorted(twice, var), len(twice) - 1)
        hit = np.flatnonzero(twice[pos] == var)
        who, run, inner = who[hit], pos[hit], inner[hit]
        hub = np.full(len(twice), len(fps))
        np.minimum.at(hub, run[inner], who[inner])
        a, b = who, hub[run]
        ok = b < len(fps)
        a, b = a[ok], b[ok]
        near = np.bitwise_count(fps[a] ^ fps[b]) <= self.radius
        a, b = a[near], b[near]
        lab = run_labels(len(fps), a, b)
        on = np.flatnonzero(lab != np.arange(len(fps)))
        return fps[on], fps[lab[on]]


def ball_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Distinct longs ``fp`` -> (a, b): links that join all fingerprints within ``radius`` bits."""
    spark = fps.sparkSession
    size = sum(1 for n in range((radius + 1) // 2 + 1) for _ in combinations(range(64), n))
    total = fps.count() * size
    buckets = max(16, shuffle_partitions(spark), total / BUCKET_VARIANTS)
    bits = min(24, int(np.ceil(np.log2(buckets))))
    ball = spark.sparkContext.broadcast(Ball(radius, bits))

    def deal(batches):
        bl = ball.value
        for batch in batches:
            x = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for bucket, at, dealt in bl.deal(x):
                ends = np.append(at, len(dealt)) * 8
                for i in range(0, len(bucket), 256):
                    e = ends[i:i + 257]
                    data = pa.py_buffer(dealt[e[0] // 8:e[-1] // 8].tobytes())
                    offsets = pa.py_buffer((e - e[0]).astype(np.int32).tobytes())
                    packed = pa.Array.from_buffers(pa.binary(), len(e) - 1, [None, offsets, data])
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[i:i + 256], pa.int32()), packed], ["bucket", "data"])

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(pdf["data"]), np.uint64)
        a, b = ball.value.roots(np.sort(x), int(key[0]))
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    packed = fps.select("fp").mapInArrow(deal, "bucket int, data binary")
    return packed.groupBy("bucket").applyInPandas(meet, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, keep: list[str] | None = None) -> DataFrame:
    """doc_id, fp, component_id, class (one value per component), and the columns of ``keep``."""
    keep = ["doc_id", *(c for c in keep or [] if c != "doc_id")]
    d = stage(fingerprints(docs, shingle, keep), "simhash-fp")
    f = stage(d.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = connected_components(ball_links(f.select("fp"), radius))
    f = f.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("class", F.coalesce("root", "fp"))
    least = f.groupBy("class").agg(F.min("first").alias("component_id"))
    f = f.select("fp", "class").join(least, "class")
    return d.join(f, "fp")


def query(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    out = near_duplicates(docs.select("doc_id", text_bytes().alias("text")), shingle, radius)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row of every near-duplicate group: the smallest doc_id (null last), then text hash."""
    cols = docs.columns
    keyed = docs.select("*", *doc_key())
    found = near_duplicates(keyed.select("doc_id", *KEY, text_bytes().alias("text")), shingle, radius, KEY)
    first = found.groupBy("class").agg(F.min(F.struct(KEY[1], KEY[0], KEY[2])).alias("k")).select("k.*")
    one = keyed.join(first, KEY, "left_semi")
    repeated = found.groupBy(*KEY).count().where("count > 1").join(first, KEY, "left_semi")
    if not repeated.isEmpty():
        one = one.dropDuplicates(KEY)
    return one.select(*cols)
