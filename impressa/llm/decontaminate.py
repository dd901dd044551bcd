"""Benchmark decontamination by SimHash over item-sized windows (operator 2).

For every benchmark item of n words all windows of n words of every document
are candidates.  Windows and items have a 64-bit SimHash of their weighted
five-word shingles (weight: occurrences).  Item fingerprints are kept in a
multi-index by length: the 64 bits are cut into six blocks, and by the
pigeonhole rule two fingerprints within 18 bits agree within 3 bits on some
block, so looking up every block value among all values within 3 bits of an
item's block finds all items within the radius; none is missed.  Candidates
within the radius are verified exactly: multiset Jaccard similarity of the
shingles, 0.8 or more.

Windows that hold no shingle of any item have similarity 0 and are not
fingerprinted; to get there all shingles of all documents are compared, from
the hashes of words that items have (other words hash to zero first).  Documents
shorter than an item are one window.  Texts are walked in pieces, so memory
does not grow with their length.

Scale: one narrow pass over documents.  Items are broadcast in blocks of about
``BLOCK_WORDS`` words and ``BLOCK_ITEMS`` items at most (as many passes as
blocks), so words, shingles and multi-index (1392 entries an item) are bounded
for any benchmark, also one of many short items.

Defined results: null or empty texts and items match nothing; items under five
words are one shingle of their own length; null ids are reported as null;
repeated rows and items are each reported once per distinct (doc_id, item_id),
with their best window; ties go to the first window; empty tables give no
rows; other columns pass through ``remove``.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impressa.llm.common import WORD, text_bytes, words

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 18
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
BLOCK_WORDS = 500_000
BLOCK_ITEMS = 20_000
STEP = 4096


_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_hash(w: bytes) -> int:
    return xxhash.xxh64_intdigest(w, 3) | 1


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-word shingles from word hashes; fewer words: of the whole sequence."""
    k = min(k, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        out = (out ^ h[j:len(h) - k + 1 + j]) * _ODD
        out ^= out >> np.uint64(29)
    return out


def _signs(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def _pack(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1).view(">u8").astype(np.uint64).ravel()


class LengthIndex:
    """Items of one length: fingerprints, shingle counts, and the block tables."""

    def __init__(self, n_words: int, items: list[tuple[int, np.ndarray]]):
        self.k = min(SHINGLE, n_words)
        self.width = n_words - self.k + 1
        self.ids = [i for i, _ in items]
        self.counts = [np.unique(h, return_counts=True) for _, h in items]
        self.fps = np.concatenate([_pack((2 * _signs(h).sum(0, dtype=np.int64) > len(h))[None, :]) for _, h in items])
        self.tables = []
        for at, bits in BLOCKS:
            v = (self.fps >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64)
            masks = np.array([sum(1 << i for i in c) for n in range(RADIUS // len(BLOCKS) + 1) for c in combinations(range(bits), n)])
            near = (v[:, None] ^ masks[None, :]).ravel()
            who = np.repeat(np.arange(len(v), dtype=np.int32), len(masks))
            order = np.argsort(near, kind="stable")
            start = np.searchsorted(near[order], np.arange((1 << bits) + 1))
            self.tables.append((at, bits, start, who[order]))

    def near(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of all pairs within the radius."""
        pairs = []
        for at, bits, start, who in self.tables:
            v = (fps >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64)
            n = start[v + 1] - start[v]
            w = np.repeat(np.arange(len(fps)), n)
            i = who[np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[v], n)]
            d = np.bitwise_count(fps[w] ^ self.fps[i])
            ok = d <= RADIUS
            pairs.append(w[ok] * len(self.ids) + i[ok])
        p = np.unique(np.concatenate(pairs))
        w, i = p // len(self.ids), p % len(self.ids)
        return w, i, np.bitwise_count(fps[w] ^ self.fps[i])

    def similarity(self, item: int, window: np.ndarray) -> float:
        h, n = np.unique(window, return_counts=True)
        ih, im = self.counts[item]
        at = np.minimum(np.searchsorted(ih, h), len(ih) - 1)
        both = np.minimum(n, im[at])[ih[at] == h].sum()
        return float(both / (n.sum() + im.sum() - both))


class Index:
    """All items of a block, by length, with the set of their shingles."""

    def __init__(self, items: list[tuple[int, bytes]]):
        by: dict[int, list] = {}
        self.words: dict[bytes, int] = {}
        for i, text in items:
            w = words(text)
            if w:
                self.words.update((x, word_hash(x)) for x in w)
                by.setdefault(len(w), []).append((i, shingles(np.array([self.words[x] for x in w], np.uint64), SHINGLE)))
        self.lengths = {n: LengthIndex(n, x) for n, x in sorted(by.items())}
        self.known = {k: np.unique(np.concatenate([c[0] for x in self.lengths.values() if x.k == k for c in x.counts]))
                      for k in {x.k for x in self.lengths.values()}}
        self.filter = {}
        for k, h in self.known.items():
            self.filter[k] = np.zeros(1 << 22, bool)
            self.filter[k][(h & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def hits(self, text: bytes, first: bool = False) -> dict[int, tuple[float, int, int, int]]:
        """item -> (similarity, distance, first word, words); with ``first`` any one item."""
        best: dict[int, tuple] = {}
        w = words(text)
        if not w:
            return best
        rough = np.fromiter(map(self.words.get, w, repeat(0)), np.uint64, len(w))
        exact = None
        for k, known in self.known.items():
            h = shingles(rough, k)
            on = np.flatnonzero(self.filter[k][(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
            on = on[known[np.minimum(np.searchsorted(known, h[on]), len(known) - 1)] == h[on]]
            if not len(on):
                continue
            if exact is None:
                exact = np.fromiter((self.words.get(x) or word_hash(x) for x in w), np.uint64, len(w))
            h = shingles(exact, k)
            widest = max(x.width for x in self.lengths.values() if x.k == k)
            for lo in range(max(0, int(on[0]) - widest), int(on[-1]) + 1, STEP):
                part = h[lo:lo + STEP + widest]
                a = np.searchsorted(on, [lo, lo + len(part)])
                if a[0] == a[1]:
                    continue
                seen = np.zeros(len(part) + 1, np.int64)
                seen[on[a[0]:a[1]] - lo + 1] = 1
                seen = np.cumsum(seen)
                ones = np.zeros((len(part) + 1, 64), np.int32)
                np.cumsum(_signs(part), axis=0, dtype=np.int32, out=ones[1:])
                for x in self.lengths.values():
                    if x.k == k:
                        self._windows(x, part, lo, len(h), seen, ones, best)
                        if first and best:
                            return best
        return best

    @staticmethod
    def _windows(x: LengthIndex, part, lo, total, seen, ones, best) -> None:
        width = min(x.width, total)
        last = min(STEP, len(part) - width + 1)
        if last <= 0:
            return
        s = np.flatnonzero(seen[width:width + last] > seen[:last])
        if not len(s):
            return
        fps = _pack(2 * (ones[s + width] - ones[s]) > width)
        for w, i, d in zip(*(a.tolist() for a in x.near(fps))):
            at = int(s[w])
            sim = x.similarity(i, part[at:at + width])
            if sim >= SIMILARITY:
                item = x.ids[i]
                if item not in best or sim > best[item][0]:
                    best[item] = (sim, int(d), lo + at, width + x.k - 1)


def _blocks(bench: DataFrame):
    """Benchmark items in blocks of bounded size, each as a broadcast index."""
    spark = bench.sparkSession
    items = bench.select(F.col("item_id").cast("long"), text_bytes().alias("text"), F.regexp_count("text", F.lit(WORD)).alias("n"))
    total, count = items.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n = max(-(-total // BLOCK_WORDS), -(-count // BLOCK_ITEMS))
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).select("item_id", "text").distinct().collect()
        if rows:
            yield spark.sparkContext.broadcast(Index(sorted(((r[0], bytes(r[1])) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))))


def contamination(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, distance, first_word, n_words): one row per contaminated pair."""
    schema = "doc_id long, item_id long, similarity double, distance int, first_word long, n_words long"
    d = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text"))
    out = None
    for shared in _blocks(bench):
        def run(batches, shared=shared):
            for b in batches:
                rows = [(i, item, *v) for i, x in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())
                        for item, v in shared.value.hits(x).items()]
                cols = list(zip(*rows)) if rows else [[]] * 6
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [x.split()[0] for x in schema.split(", ")])

        got = d.mapInArrow(run, schema)
        out = got if out is None else out.unionByName(got)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    order = F.struct(-F.col("similarity"), F.col("first_word"), F.col("distance"), F.col("n_words"))
    best = out.groupBy("doc_id", "item_id").agg(F.min(order).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.col1")).alias("similarity"), "b.distance", "b.first_word", "b.n_words")


def remove(docs: DataFrame, bench: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the contaminated rows; same columns."""
    def leaks(shared):
        @F.pandas_udf("boolean")
        def test(s: pd.Series) -> pd.Series:
            return pd.Series([bool(shared.value.hits(x, True)) for x in s], dtype=bool)

        return test

    out = docs
    for shared in _blocks(bench):
        out = out.where(~leaks(shared)(text_bytes(text)))
    return out


def query(docs: DataFrame, bench: DataFrame) -> DataFrame:
    return contamination(docs, bench)
