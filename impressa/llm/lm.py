"""LM scoring with a log-frequency Bloom filter (operator 5).

A bigram model (documents end in one end token, which also starts them).
Counts are quantised to levels 1 + floor(log2 c), and an n-gram of level q is
put into a Bloom filter once for each level 1..q.  A count is read back by
probing level after level until the first miss, and is taken as the middle of
its level.  Probabilities are smoothed with those counts: the bigram estimate
is backed by the unigram one with weight ``SMOOTH`` (Dirichlet prior), and
that by add-0.1.

Tasks count the distinct n-grams of their training rows and send each with its
count to a segment (the n-gram's hash chooses it).  A segment sums the counts
and builds its own bit array; word counts stay exact beside it (words are known
by 64-bit hashes).  The staged segments together are the filter.  It takes about ``BITS``
bits for each filter entry, so it grows with the n-grams of the corpus and its
false-positive rate does not.

A filter of at most ``BROADCAST_BYTES`` (checked) is broadcast, and workers probe
it for the distinct n-grams of a batch of rows.  A larger one stays where it
is: rows are packed into pieces of about ``PIECE_BYTES`` of text, a piece sends its
distinct n-grams to the segments, and these probe their own bits and send back
levels.  Either way reads the same bits and gives the same scores.

The base score needs exact counts of every token.  Words at or above a count
chosen so that at most ``TOP`` words qualify are broadcast; all rarer words
of a document go through one join with the count table.  Both ways are taken at every size.

Defined results: null text is empty; an empty text is one end token; without
training rows N = V = 0 and base terms are log10(0.1/0.1) = 0, and the model
gives each token log10(1) = 0 likewise; null ids hash as the empty text and
keep their rows; repeated rows are scored alike and counted each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impressa.llm.common import crc_bucket, shuffle_partitions, text_bytes, words
from impressa.sources.sinks import stage

#: A text's end; no word can hold a line break.
END = b"\n"
TOP = 1 << 18
BITS = 10
PROBES = 4
#: A filter up to this size is broadcast.
BROADCAST_BYTES = 256 << 20
LEVELS = 40
SMOOTH = 2.0
ADD = 0.1
#: Text bytes that one segment stands for, on average, at most.
SEGMENT_BYTES = 12_000_000
MEMO = 200_000
#: Text bytes of a piece, give or take one text.
PIECE_BYTES = 8 << 20
#: Distinct n-grams that a task holds while it counts.
HELD = 2_000_000
#: Tokens that are scored together.
PIECE = 400_000
_K1, _K2, _K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(33))) * _K2
    h = (h ^ (h >> np.uint64(29))) * _K3
    return h ^ (h >> np.uint64(32))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _K1 + (b ^ _K2))


def word_hash(w: bytes) -> int:
    return xxhash.xxh64_intdigest(w, 7)


class Hasher(dict):
    """Word -> 64-bit hash, with a bounded memo."""

    def __missing__(self, w: bytes) -> int:
        h = self[w] = word_hash(w)
        return h

    def text(self, text: bytes) -> np.ndarray:
        """Hashes of the tokens, the end token last."""
        if len(self) > MEMO:
            self.clear()
        w = words(text)
        w.append(END)
        return np.fromiter(map(self.__getitem__, w), np.uint64, len(w))


def bigrams(tokens: np.ndarray) -> np.ndarray:
    """Hashes of the bigrams of a text; the first starts at the end token."""
    return pair_hash(np.concatenate((tokens[-1:], tokens[:-1])), tokens)


def level(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(counts)).astype(np.int64)


def middle(levels: np.ndarray) -> np.ndarray:
    """Count that a level stands for: the middle of 2^(q-1) .. 2^q - 1; 0 for none."""
    return np.where(levels > 0, (2.0 ** (levels - 1) + 2.0 ** levels - 1) / 2, 0.0)


def positions(h: np.ndarray, q: np.ndarray, bits: np.ndarray) -> list[np.ndarray]:
    """Bit positions of (n-gram, level) in segments of ``bits`` bits."""
    a = mix(h + q.astype(np.uint64) * _K1)
    b = mix(a ^ _K3) | np.uint64(1)
    return [(a + np.uint64(i) * b) % bits for i in range(PROBES)]


def build_segment(h: np.ndarray, counts: np.ndarray, most_bytes: int | None = None) -> bytes:
    """Bit array of the n-grams ``h`` with their counts; scoring sets no ``most_bytes``."""
    q = level(counts)
    size = int(max(64, q.sum() * BITS // 8 + 8))
    size = size if most_bytes is None else min(size, most_bytes)
    out = np.zeros(size * 8, np.uint8)
    bits = np.uint64(size * 8)
    for j in range(1, int(q.max(initial=0)) + 1):
        on = h[q >= j]
        for p in positions(on, np.full(len(on), j), bits):
            out[p.astype(np.int64)] = 1
    return np.packbits(out).tobytes()


class Ngrams:
    """Distinct n-grams of a piece's texts, and their order by segment; the same for the same texts."""

    def __init__(self, texts: list[np.ndarray], segments: int):
        self.tokens = np.concatenate(texts)
        self.pairs = np.concatenate([bigrams(x) for x in texts])
        self.uni, self.uni_back = np.unique(self.tokens, return_inverse=True)
        self.bi, self.bi_back = np.unique(self.pairs, return_inverse=True)
        self.uni_order, self.uni_cut = self.deal(mix(self.uni), segments)
        self.bi_order, self.bi_cut = self.deal(self.bi, segments)

    @staticmethod
    def deal(h: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
        s = (h % np.uint64(segments)).astype(np.int64)
        order = np.argsort(s, kind="stable")
        return order, np.searchsorted(s[order], np.arange(segments + 1))

    def requests(self) -> Iterator[tuple]:
        """(segment, words, bigrams) for every segment that has some."""
        uni, bi = self.uni[self.uni_order], self.bi[self.bi_order]
        for i, (p, q, x, y) in enumerate(zip(self.uni_cut[:-1], self.uni_cut[1:], self.bi_cut[:-1], self.bi_cut[1:])):
            if q > p or y > x:
                yield i, uni[p:q].tobytes(), bi[x:y].tobytes()

    def counts(self, answers: Iterable[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Counts of ``uni`` and ``bi`` from the segments' levels."""
        uni, bi = np.zeros(len(self.uni), np.int64), np.zeros(len(self.bi), np.int64)
        for i, data in answers:
            q = np.frombuffer(data, np.uint8)
            at = self.uni_order[self.uni_cut[i]:self.uni_cut[i + 1]]
            uni[at], bi[self.bi_order[self.bi_cut[i]:self.bi_cut[i + 1]]] = q[:len(at)], q[len(at):]
        return middle(uni), middle(bi)


def narrow(n: np.ndarray) -> bytes:
    """Counts as one byte each where 0..254, or 255 and then four bytes at the end."""
    big = n >= 255
    return np.where(big, 255, n).astype(np.uint8).tobytes() + n[big].astype("<u4").tobytes()


def wide(data: bytes, size: int) -> np.ndarray:
    n = np.frombuffer(data, np.uint8, size).astype(np.int64)
    n[n == 255] = np.frombuffer(data, "<u4", offset=size)
    return n


def sent(h: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending distinct hashes and their counts, compressed."""
    gaps = np.diff(h, prepend=np.uint64(0))
    # byte by byte, so that the high bytes, mostly zero, lie together
    planes = gaps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(np.int64(len(h)).tobytes() + planes + narrow(n))


def received(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    size = int(np.frombuffer(raw, np.int64, 1)[0])
    gaps = np.frombuffer(raw, np.uint8, 8 * size, 8).reshape(8, -1).T.copy().view("<u8").reshape(-1) if size else np.empty(0, np.uint64)
    return np.cumsum(gaps, dtype=np.uint64), wide(raw[8 + 8 * size:], size)


def summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes with the sums of their counts, those above 0."""
    h, back = np.unique(h, return_inverse=True)
    n = np.bincount(back, n, len(h)).astype(np.int64)
    return h[n > 0], n[n > 0]


@dataclass(frozen=True)
class Model:
    """Segments of the filter side by side, the frequent words with exact counts, and the totals."""

    data: np.ndarray
    starts: np.ndarray
    bits: np.ndarray
    frequent: np.ndarray
    frequent_counts: np.ndarray
    total: int
    vocabulary: int

    @staticmethod
    def of_segments(parts: dict[int, bytes], segments: int) -> Model:
        """A model of the filter alone; a segment that is not there holds nothing."""
        size = np.array([len(parts.get(i, b"\0")) for i in range(segments)], np.int64)
        starts = np.cumsum(size) - size
        data = np.zeros(int(size.sum()), np.uint8)
        for i, part in parts.items():
            data[starts[i]:starts[i] + size[i]] = np.frombuffer(part, np.uint8)
        none = np.empty(0, np.uint64)
        return Model(data, starts, (size * 8).astype(np.uint64), none, none.astype(np.int64), 0, 0)

    def with_segments(self, parts: dict[int, bytes], segments: int) -> Model:
        f = Model.of_segments(parts, segments)
        return replace(self, data=f.data, starts=f.starts, bits=f.bits)

    def count_levels(self, h: np.ndarray) -> np.ndarray:
        """Levels read by repeated membership probes."""
        out = np.zeros(len(h), np.int64)
        if not len(self.starts):
            return out
        byte = np.frombuffer(self.data, np.uint8)  # bytes or an array of them
        seg = (h % np.uint64(len(self.starts))).astype(np.int64)
        live, hh = np.arange(len(h)), h
        for j in range(1, LEVELS):
            first, bits = self.starts[seg], self.bits[seg]
            hit = np.ones(len(hh), bool)
            for p in positions(hh, np.full(len(hh), j), bits):
                at = first + (p >> np.uint64(3)).astype(np.int64)
                hit &= (byte[at] >> (7 - (p & np.uint64(7)).astype(np.uint8))) & 1 == 1
            live, hh, seg = live[hit], hh[hit], seg[hit]
            if not len(live):
                break
            out[live] = j
        return out

    def exact(self, words: np.ndarray) -> np.ndarray:
        """Exact counts of frequent words, 0 for the others."""
        if not len(self.frequent):
            return np.zeros(len(words), np.int64)
        i = np.minimum(np.searchsorted(self.frequent, words), len(self.frequent) - 1)
        return np.where(self.frequent[i] == words, self.frequent_counts[i], 0)

    def score(self, texts: list[np.ndarray], ngrams: Ngrams, uni_counts: np.ndarray, bi_counts: np.ndarray) -> Iterator[tuple]:
        """For each text's token hashes: tokens, known frequent ones, their base terms' sum, the model's
        log10 probability, and the rare words with their numbers.  Counts are those read for ``ngrams``."""
        size = np.array([len(t) for t in texts])
        t = np.concatenate(texts)
        ends = np.cumsum(size)
        word, back = np.unique(t, return_inverse=True)
        exact = self.exact(word)
        whole = self.total + ADD * (self.vocabulary + 1)
        base = np.where(exact > 0, np.log10((exact + ADD) / whole), 0.0)[back]
        known = (exact > 0)[back]
        uni = uni_counts[np.searchsorted(ngrams.uni, word)][back]
        bi = bi_counts[np.searchsorted(ngrams.bi, np.concatenate([bigrams(x) for x in texts]))]
        before = np.empty_like(uni)
        before[1:] = uni[:-1]
        before[ends - size] = uni[ends - 1]
        p1 = (uni + ADD) / whole
        log = np.log10(np.maximum((np.minimum(bi, before) + SMOOTH * p1) / (before + SMOOTH), 1e-300))
        for a, b in zip(ends - size, ends):
            rare, n = np.unique(t[a:b][~known[a:b]], return_counts=True)
            yield int(b - a), int(known[a:b].sum()), float(base[a:b].sum()), float(log[a:b].sum()), rare.view(np.int64), n.astype(np.int32)


def packed(docs: DataFrame) -> DataFrame:
    """(piece, data): runs of rows as compressed Arrow streams; a piece's number is that of its first row."""

    def run(batches):
        rid = TaskContext.get().partitionId() << 36
        for b in batches:
            size = pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
            part = (np.cumsum(size) - size) // PIECE_BYTES
            cut = [0, *(np.flatnonzero(np.diff(part)) + 1), len(part)] if len(part) else [0]
            for x, y in zip(cut[:-1], cut[1:]):
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_batch(b.slice(x, y - x))
                yield pa.RecordBatch.from_arrays([pa.array([rid + x], pa.int64()), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["piece", "data"])
            rid += len(part)

    return docs.mapInArrow(run, "piece long, data binary")


def unpacked(data: bytes, hasher: Hasher) -> tuple[pa.Table, list[np.ndarray]]:
    """The rows of a piece, and their token hashes."""
    t = pa.ipc.open_stream(data).read_all()
    return t, [hasher.text(x) for x in t.column("text").to_pylist()]


class Tally:
    """Counts of distinct n-grams, gathered from batches and given out by segment."""

    def __init__(self, segments: int):
        self.segments, self.parts, self.held = segments, ([], []), 0

    def add(self, texts: list[np.ndarray]) -> None:
        for part, h in zip(self.parts, (np.concatenate(texts), np.concatenate([bigrams(x) for x in texts]))):
            part.append(np.unique(h, return_counts=True))
            self.held += len(part[-1][0])
        if self.held > HELD:
            self._merge()

    def _merge(self) -> None:
        for part in self.parts:
            if part:
                part[:] = [summed(np.concatenate([h for h, _ in part]), np.concatenate([n for _, n in part]))]
        self.held = sum(len(part[0][0]) for part in self.parts if part)

    @property
    def full(self) -> bool:
        return self.held > HELD

    def rows(self) -> Iterator[tuple]:
        """(segment, words, bigrams), each as ``sent`` packs them."""
        self._merge()
        none = np.empty(0, np.uint64), np.empty(0, np.int64)
        dealt = []
        for part, key in zip(self.parts, (mix, lambda h: h)):
            h, n = part[0] if part else none
            order, cut = Ngrams.deal(key(h), self.segments)
            dealt.append((h[order], n[order], cut))
        (u, un, uc), (b, bn, bc) = dealt
        for i in range(self.segments):
            if uc[i + 1] > uc[i] or bc[i + 1] > bc[i]:
                yield i, sent(u[uc[i]:uc[i + 1]], un[uc[i]:uc[i + 1]]), sent(b[bc[i]:bc[i + 1]], bn[bc[i]:bc[i + 1]])
        self.parts, self.held = ([], []), 0


def _batches(rows, kinds, names, size: int = 256) -> Iterator[pa.RecordBatch]:
    out = []
    for r in rows:
        out.append(r)
        if len(out) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def grouped_texts(texts: Iterable[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Runs of texts of about ``PIECE`` tokens."""
    held, size = [], 0
    for x in texts:
        held.append(x)
        size += len(x)
        if size > PIECE:
            yield held
            held, size = [], 0
    if held:
        yield held


def built_filter(train: DataFrame, segments: int) -> DataFrame:
    """(segment, words, counts, bits): exact counts of a segment's words, and its part of the filter."""

    def send(batches):
        hasher, tally = Hasher(), Tally(segments)

        def rows():
            for b in batches:
                for texts in grouped_texts(hasher.text(x) for x in b.column("text").to_pylist()):
                    tally.add(texts)
                    if tally.full:
                        yield from tally.rows()
            yield from tally.rows()

        yield from _batches(rows(), (pa.int32(), pa.binary(), pa.binary()), ["segment", "uni", "bi"])

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        (w, c), (h, n) = (summed(*map(np.concatenate, zip(*map(received, pdf[k])))) for k in ("uni", "bi"))
        data = build_segment(np.concatenate((mix(w), h)), np.concatenate((c, n)))
        return pd.DataFrame({"segment": [key[0]], "words": [w.view(np.int64)], "counts": [c], "bits": [data]})

    rows = train.select("text").mapInArrow(send, "segment int, uni binary, bi binary")
    return rows.groupBy("segment").applyInPandas(build, "segment int, words array<long>, counts array<long>, bits binary")


def answered(pieces: DataFrame, built: DataFrame, segments: int) -> DataFrame:
    """(piece, segment, levels): the levels that segments read for the n-grams of pieces."""

    def send(batches):
        hasher = Hasher()

        def rows():
            for b in batches:
                for piece, data in zip(b.column("piece").to_pylist(), b.column("data")):
                    yield from ((piece, *x) for x in Ngrams(unpacked(data.as_py(), hasher)[1], segments).requests())

        yield from _batches(rows(), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), ["piece", "segment", "uni", "bi"])

    def answer(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        part = Model.of_segments({0: own["bits"].iloc[0]} if len(own) else {}, 1)
        levels = [part.count_levels(np.concatenate((mix(np.frombuffer(u, np.uint64)), np.frombuffer(b, np.uint64)))).astype(np.uint8).tobytes()
                  for u, b in zip(asked["uni"], asked["bi"])]
        return pd.DataFrame({"piece": asked["piece"], "segment": asked["segment"], "levels": levels})

    asked = pieces.mapInArrow(send, "piece long, segment int, uni binary, bi binary")
    return asked.groupBy("segment").cogroup(built.groupBy("segment")).applyInPandas(answer, "piece long, segment int, levels binary")


@dataclass(frozen=True)
class Fitted:
    model: Model
    counts: DataFrame  # (word, c), the word's hash and its exact count
    rare_below: int
    filter: DataFrame  # (segment, words, counts, bits)
    segments: int
    filter_bytes: int


def fit(docs: DataFrame) -> Fitted:
    """Learn from the rows of ``docs`` that are not held_out (text as bytes)."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    segments = int(max(16, 2 * shuffle_partitions(spark), size // SEGMENT_BYTES))
    built = stage(built_filter(docs.where(~F.col("held_out")), segments), "lm-filter")
    counts = built.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).select(F.col("x.words").alias("word"), F.col("x.counts").alias("c"))
    by = {r["c"]: r["n"] for r in counts.groupBy("c").agg(F.count("*").alias("n")).collect()}
    total, vocabulary = sum(c * n for c, n in by.items()), sum(by.values())
    held, least = 0, max(by, default=0) + 1
    for c in sorted(by, reverse=True):
        if held + by[c] > TOP:
            break
        held, least = held + by[c], c
    often = counts.where(F.col("c") >= least).orderBy("word").collect()
    frequent = np.array([r["word"] for r in often], np.int64).view(np.uint64)
    order = np.argsort(frequent)
    filter_bytes = built.agg(F.sum(F.length("bits"))).first()[0] or 0
    model = Model(np.empty(0, np.uint8), np.empty(0, np.int64), np.empty(0, np.uint64), frequent[order], np.array([r["c"] for r in often], np.int64)[order], total, vocabulary)
    return Fitted(model, counts, least, built, segments, filter_bytes)


_OWN = "rid long, n_tokens long, known long, base double, score double, rare array<long>, times array<int>"
_OWN_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int32()))


def _by_broadcast(docs: DataFrame, fitted: Fitted, kept) -> DataFrame:
    """Rows scored against the whole filter, which workers hold."""
    parts = {r["segment"]: bytes(r["bits"]) for r in fitted.filter.select("segment", "bits").toLocalIterator()}
    shared = docs.sparkSession.sparkContext.broadcast(fitted.model.with_segments(parts, fitted.segments))
    del parts
    names = [f.name for f in kept] + [x.split()[0] for x in _OWN.split(", ")]

    def run(batches):
        m, rid, hasher = shared.value, TaskContext.get().partitionId() << 36, Hasher()
        for b in batches:
            out = []
            for texts in grouped_texts(hasher.text(x) for x in b.column("text").to_pylist()):
                g = Ngrams(texts, 1)
                out += m.score(texts, g, middle(m.count_levels(mix(g.uni))), middle(m.count_levels(g.bi)))
            if out:
                cols = [np.arange(rid, rid + len(out)), *zip(*out)]
                yield pa.RecordBatch.from_arrays([b.column(f.name) for f in kept] + [pa.array(c, k) for c, k in zip(cols, _OWN_KINDS)], names)
            rid += len(out)

    return docs.mapInArrow(run, _schema(kept))


def _schema(kept) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [_OWN])


def _by_segments(docs: DataFrame, fitted: Fitted, kept) -> DataFrame:
    """Rows scored by pieces, which ask the segments for levels."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted.model)
    names = [f.name for f in kept] + [x.split()[0] for x in _OWN.split(", ")]
    segments = fitted.segments
    pieces = stage(packed(docs), "lm-pieces")
    answers = answered(pieces, fitted.filter.select("segment", "bits"), segments)

    def run(piece: pa.Table, own: pa.Table) -> pa.Table:
        m, rid = shared.value, piece.column("piece")[0].as_py()
        t, texts = unpacked(piece.column("data")[0].as_py(), Hasher())
        g = Ngrams(texts, segments)
        uni, bi = g.counts(zip(own.column("segment").to_pylist(), own.column("levels").to_pylist()))
        out = [x for part in grouped_texts(texts) for x in m.score(part, g, uni, bi)]
        cols = [np.arange(rid, rid + len(out)), *zip(*out)]
        return pa.Table.from_arrays([t.column(f.name) for f in kept] + [pa.array(c, k) for c, k in zip(cols, _OWN_KINDS)], names)

    return pieces.groupBy("piece").cogroup(answers.groupBy("piece")).applyInArrow(run, _schema(kept))


def score(docs: DataFrame, fitted: Fitted, keep: list[str], broadcast_bytes: int | None = None) -> DataFrame:
    """``keep`` columns, n_tokens, n_known, base_score and score for each row of ``docs`` (text as bytes)."""
    kept = docs.select(*keep).schema
    small = fitted.filter_bytes <= (BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes)
    first = stage((_by_broadcast if small else _by_segments)(docs, fitted, kept), "lm-scored")
    log_all = F.lit(math.log10(fitted.model.total + ADD * (fitted.model.vocabulary + 1)))
    rare = first.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("rid", F.col("r.rare").alias("word"), F.col("r.times").alias("n"))
    seen = fitted.counts.where(F.col("c") < fitted.rare_below)
    term = F.col("n") * (F.log10(F.coalesce("c", F.lit(0)) + ADD) - log_all)
    sums = rare.join(seen, "word", "left").groupBy("rid").agg(F.sum(term).alias("b2"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("k2"))
    out = first.drop("rare", "times").join(sums, "rid", "left")
    return out.select(*[F.col(f.name) for f in kept], "n_tokens", (F.col("known") + F.coalesce("k2", F.lit(0))).cast("long").alias("n_known"),
                      (F.col("base") + F.coalesce("b2", F.lit(0.0))).alias("base_score"), "score")


def query(docs: DataFrame) -> DataFrame:
    out_of: Column = crc_bucket("doc_id", 10) == 0
    d = docs.select("doc_id", out_of.alias("held_out"), text_bytes().alias("text"))
    fitted = fit(d)
    out = score(d, fitted, ["doc_id", "held_out"])
    return out.withColumn("train_tokens", F.lit(fitted.model.total).cast("long"))
