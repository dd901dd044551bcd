"""Cross-tokenizer alignment, counted externally by spilled runs.

Every text is encoded by a byte-level BPE (A) and a piece tokenizer (B).  Byte
offsets at which tokens of both end cut the text into groups; all A and B
tokens of a group are linked.  A pair of ids counts the documents that hold it
linked.  A document gets, over its links, the sum of these counts and the
number of links whose count is the highest of their A id.

* Tasks encode documents and gather pair-document records.  When a buffer is
  full it is sorted into a run: pairs in side-major order (by A id, then B id),
  radix-partitioned by A id, each slice compressed with zstd and written to
  the shared staging folder with the documents of each pair.
* A slice's pairs and their numbers of documents (not the documents) go to the
  task of their radix, where a k-way heap merge over blocks of pairs counts
  them.  More runs than the fan-in merge by levels.  As pairs come in
  side-major order, the maximum of an A id is known once its last pair has
  passed, and counts stream back to the runs at that point.
* A run's slices meet the counts of their pairs and add them up by document.

A frequent A id holds at most one pair a B id and run, so neither it nor a pair
that most documents hold weighs more in the merge than any other.

Text lies in the run's task as long as its batch; digests are taken over slices
of tokens.  In a group so large that its links outnumber its tokens by far,
equal ids are taken together before they are paired.

Defined results: texts that are null, empty, or whose joined token bytes differ
from a space and the text have no tokens: zeros and an empty digest.  Every
row is a document of its own, also with null or repeated ``doc_id``.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impressa.llm.common import shuffle_partitions
from impressa.llm.token_count import byte_of_symbol
from impressa.sources.sinks import stage

#: Pair-document records of a run, and text bytes encoded at a time.
RUN_RECORDS = 4_000_000
RUN_DOCUMENTS = 1 << 16
BATCH_BYTES = 2 << 20
LINKS_AT_ONCE = 1 << 21
#: A group of more links than this has equal ids taken together first.
LARGE_GROUP = 512
FAN_IN = 128
BLOCK = 4096
#: The fast encoder runs out of stack on white space runs of some hundred thousand characters; those texts go to the library of the file.
LONG_BLANK = re.compile(r"\s{50000}")

_RUNS = "kind string, run long, radix int, pairs binary, counts binary, body binary"
_RUN_SCHEMA = pa.schema([("kind", pa.string()), ("run", pa.int64()), ("radix", pa.int32()), ("pairs", pa.binary()), ("counts", pa.binary()), ("body", pa.binary())])
_DOCS = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
                   ("groups_sha256", pa.string())])
_OUT = pa.schema([*list(_DOCS)[:5], ("n_best", pa.int64()), ("count_sum", pa.int64()), _DOCS.field("groups_sha256")])
_OUT_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of non-negative integers, each in the narrowest width, as one zstd frame."""
    parts = []
    for a in arrays:
        top = int(a.max(initial=0))
        a = a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)
        parts += [np.array([a.itemsize, len(a)], np.int64).tobytes(), a.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(frame: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(frame), 0, []
    while at < len(raw):
        width, n = np.frombuffer(raw, np.int64, 2, at).tolist()
        out.append(np.frombuffer(raw, f"u{width}", n, at + 16).astype(np.int64))
        at += 16 + width * n
    return out


class Tokenizers:
    """Ids of both tokenizers, and the bytes of every id."""

    def __init__(self, spec: str, model: bytes, pattern: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        d, byte = json.loads(spec), byte_of_symbol()
        self.library = Tokenizer.from_str(spec)
        self.library.encode_special_tokens = True
        vocab = {bytes(byte[c] for c in t): i for t, i in d["model"]["vocab"].items()}
        made = [d["model"]["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in d["model"]["merges"]]
        if made != sorted(made):
            raise ValueError("ids must follow the order of merges")
        self.fast = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=vocab, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        a = [b""] * (max(vocab.values()) + 1)
        for w, i in vocab.items():
            a[i] = w
        p = self.pieces
        b = [bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode()
             for i in range(p.get_piece_size())]
        self.a, self.b = Vocabulary(a, b"|"), Vocabulary(b, b";")

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        a = []
        for t in texts:
            if len(t) >= 50_000 and LONG_BLANK.search(t):
                a.append(np.array(self.library.encode(" " + t, add_special_tokens=False).ids, np.int64))
            else:
                a.append(self.fast.encode_to_numpy(" " + t, disallowed_special=()).astype(np.int64))
        return a, [np.array(x, np.int64) for x in self.pieces.encode(texts, num_threads=1)]


class Vocabulary:
    def __init__(self, words: list[bytes], border: bytes):
        self.size = len(words)
        self.length = np.array([len(w) for w in words], np.int64)
        self.at = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(words), np.uint8)
        # digits of each id, followed by a comma, or by the border behind a group's last
        self.digits = np.array([[b"%d," % i for i in range(self.size)], [b"%d" % i + border for i in range(self.size)]], object)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        n = self.length[ids]
        return self.bytes[np.arange(int(n.sum())) + np.repeat(self.at[ids] - (np.cumsum(n) - n), n)]


class Aligned:
    """Groups and links of a batch of texts."""

    def __init__(self, tok: Tokenizers, texts: list[str | None]):
        self.tok = tok
        n = len(texts)
        raw = [b" " + t.encode() if t else b"" for t in texts]
        ids = tok.encode([t or "" for t in texts])
        size = np.array([len(x) for x in raw], np.int64)
        docs, ids = zip(*((np.repeat(np.arange(n), [len(x) for x in side]), np.concatenate(side) if side else np.zeros(0, np.int64)) for side in ids))
        ok = size > 1
        for d, i, v in zip(docs, ids, (tok.a, tok.b)):
            ok &= np.bincount(d, v.length[i], n).astype(np.int64) == size
        text = np.frombuffer(b"".join(x for x, y in zip(raw, ok) if y), np.uint8)
        owner = np.repeat(np.flatnonzero(ok), size[ok])
        wrong = np.zeros(len(text), bool)
        for d, i, v in zip(docs, ids, (tok.a, tok.b)):
            wrong |= v.spelled(i[ok[d]]) != text
        ok[owner[wrong]] = False
        (self.doc_a, self.a), (self.doc_b, self.b) = ((d[ok[d]], i[ok[d]]) for d, i in zip(docs, ids))
        end_a, end_b = np.cumsum(tok.a.length[self.a]), np.cumsum(tok.b.length[self.b])
        total = int(size[ok].sum())
        both, other = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        both[end_a], other[end_b] = True, True
        both &= other
        before = np.cumsum(both) - both
        self.group_a, self.group_b = before[end_a], before[end_b]
        groups = int(both.sum())
        self.size_a, self.size_b = np.bincount(self.group_a, minlength=groups), np.bincount(self.group_b, minlength=groups)
        first_a = np.cumsum(self.size_a) - self.size_a
        self.doc_of = self.doc_a[first_a] if groups else np.zeros(0, np.int64)
        self.n_a, self.n_b = np.bincount(self.doc_a, minlength=n), np.bincount(self.doc_b, minlength=n)
        self.n_groups = np.bincount(self.doc_of, minlength=n)
        self.n_links = np.zeros(n, np.int64)
        np.add.at(self.n_links, self.doc_of, self.size_a * self.size_b)

    def digests(self) -> list[str]:
        """SHA-256 of the groups, spelled out as ``a1,a2|b1;a3|b2,b3``."""
        words = np.empty(len(self.a) + len(self.b), object)
        for ids, group, earlier, v in ((self.a, self.group_a, np.cumsum(self.size_b) - self.size_b, self.tok.a),
                                       (self.b, self.group_b, np.cumsum(self.size_a), self.tok.b)):
            if len(ids):
                last = np.append(group[1:] != group[:-1], True).astype(np.int64)
                words[np.arange(len(ids)) + earlier[group]] = v.digits[last, ids]
        out, at = [], 0
        for n in (self.n_a + self.n_b).tolist():
            sha, end = hashlib.sha256(), at + n
            while at < end:
                nxt = min(end, at + LINKS_AT_ONCE)
                said = b"".join(words[at:nxt].tolist())
                sha.update(said[:-1] if nxt == end else said)
                at = nxt
            out.append(sha.hexdigest() if n else "")
        return out

    @staticmethod
    def _joined(ids, group, large, vocabulary: int):
        """(group, id, times) in order of groups; in large groups each id once."""
        big = large[group]
        if not big.any():
            return group, ids, np.ones(len(ids), np.int64)
        some, times = np.unique(group[big] * vocabulary + ids[big], return_counts=True)
        g = np.concatenate([group[~big], some // vocabulary])
        order = np.argsort(g, kind="stable")
        return g[order], np.concatenate([ids[~big], some % vocabulary])[order], np.concatenate([np.ones(int((~big).sum()), np.int64), times])[order]

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(pair, document, times) of all links, a bounded number at once; a pair is A id * size of B + B id."""
        large = self.size_a * self.size_b > LARGE_GROUP
        ga, a, times_a = self._joined(self.a, self.group_a, large, self.tok.a.size)
        gb, b, times_b = self._joined(self.b, self.group_b, large, self.tok.b.size)
        held = np.bincount(gb, minlength=len(large))
        first = np.cumsum(held) - held
        upto = np.cumsum(held[ga])
        lo = 0
        while lo < len(a):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + LINKS_AT_ONCE, side="right")))
            n = held[ga[lo:hi]]
            i = np.repeat(np.arange(lo, hi), n)
            j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + first[ga[i]]
            yield a[i] * self.tok.b.size + b[j], self.doc_of[ga[i]], times_a[i] * times_b[j]
            lo = hi


def _radix(pair: np.ndarray, b_size: int, radixes: int) -> np.ndarray:
    side = (pair // b_size).astype(np.uint64)
    return ((side * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(radixes)).astype(np.int64)


class Run:
    """Buffered documents and pair-document records, given out as compressed rows."""

    def __init__(self, number: int, b_size: int, radixes: int):
        self.number, self.b_size, self.radixes = number, b_size, radixes
        self.docs, self.records, self.times, self.n, self.held = [], [], [], 0, 0

    def add(self, columns: list[list]) -> int:
        """Documents' columns; the number of the first."""
        self.docs.append(columns)
        self.n += len(columns[0])
        return self.n - len(columns[0])

    def link(self, pair, doc, times) -> None:
        self.records.append(pair << 32 | doc)
        self.times.append(times)
        self.held += len(pair)

    def _sorted(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.records:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        records, times = np.concatenate(self.records), np.concatenate(self.times)
        self.records, self.times = [], []
        if int(times.max(initial=1)) == 1:
            records.sort()
            times = None
        else:
            order = np.argsort(records, kind="stable")
            records, times = records[order], times[order]
        first = np.flatnonzero(np.append(True, records[1:] != records[:-1]))
        own = np.diff(np.append(first, len(records))) if times is None else np.add.reduceat(times, first)
        return records[first], own

    def rows(self) -> Iterator[tuple]:
        columns = [sum((d[k] for d in self.docs), []) for k in range(len(_DOCS))]
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _DOCS)], schema=_DOCS)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _DOCS) as w:
            w.write_batch(batch)
        yield "run", self.number, -1, None, None, zstandard.ZstdCompressor(level=1).compress(sink.getvalue())
        records, times = self._sorted()
        pair, doc = records >> 32, records & 0xFFFFFFFF
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(pair)))
        radix = _radix(pair[first], self.b_size, self.radixes)
        order = np.argsort(radix, kind="stable")
        cut = np.searchsorted(radix[order], np.arange(self.radixes + 1))
        for r in range(self.radixes):
            own = order[cut[r]:cut[r + 1]]
            if len(own):
                at = np.repeat(first[own] - (np.cumsum(n[own]) - n[own]), n[own]) + np.arange(int(n[own].sum()))
                yield ("slice", self.number, r, pack(np.diff(pair[first[own]], prepend=0)), pack(n[own]), pack(n[own], doc[at], times[at] - 1))


def _record_batches(rows, schema: pa.Schema, size: int = 64) -> Iterator[pa.RecordBatch]:
    out = []
    for r in rows:
        out.append(r)
        if len(out) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


_READY: dict[bytes, Tokenizers] = {}


def _tokenizers(spec: str, model: bytes, pattern: str) -> Tokenizers:
    key = hashlib.sha256(spec.encode() + model + pattern.encode()).digest()
    if key not in _READY:
        _READY.clear()
        _READY[key] = Tokenizers(spec, model, pattern)
    return _READY[key]


def spill(docs: DataFrame, spec: str, model: bytes, pattern: str, radixes: int, records: int) -> DataFrame:
    """(doc_id, text) -> the runs: a row of documents each, and a row a slice."""
    told = docs.sparkSession.sparkContext.broadcast((spec, model, pattern))

    def texts(batches) -> Iterator[tuple[list, list]]:
        ids, held, size = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i)
                held.append(t)
                size += len(t or "") + 1
                if size >= BATCH_BYTES:
                    yield ids, held
                    ids, held, size = [], [], 0
        if ids:
            yield ids, held

    def run(batches):
        tok = _tokenizers(*told.value)
        base = TaskContext.get().partitionId() << 24

        def rows():
            nth, own = 0, None
            for ids, held in texts(batches):
                if own is None:
                    own = Run(base + nth, tok.b.size, radixes)
                al = Aligned(tok, held)
                first = own.add([ids, al.n_a.tolist(), al.n_b.tolist(), al.n_groups.tolist(), al.n_links.tolist(), al.digests()])
                for pair, doc, times in al.links():
                    own.link(pair, doc + first, times)
                if own.held >= records or own.n >= RUN_DOCUMENTS:
                    yield from own.rows()
                    nth, own = nth + 1, None
            if own is not None:
                yield from own.rows()

        yield from _record_batches(rows(), _RUN_SCHEMA)

    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _RUNS)
    return stage(got, "align-runs")


def merged(slices: list[tuple[np.ndarray, np.ndarray]], block: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """k-way merge of sorted (pairs, counts): blocks of distinct pairs in order with the sums of their counts.

    The heap holds the last pair of every slice's block; up to the least of
    these all pairs are at hand.
    """
    block = block or BLOCK
    at = [0] * len(slices)
    heap = [(int(p[min(block, len(p)) - 1]), k) for k, (p, _) in enumerate(slices) if len(p)]
    heapq.heapify(heap)
    while heap:
        last, pairs, counts = heap[0][0], [], []
        for _, k in heap:
            p, c = slices[k]
            hi = at[k] + int(np.searchsorted(p[at[k]:at[k] + block], last, side="right"))
            pairs.append(p[at[k]:hi])
            counts.append(c[at[k]:hi])
            at[k] = hi
        while heap and heap[0][0] <= last:
            _, k = heapq.heappop(heap)
            p = slices[k][0]
            if at[k] < len(p):
                heapq.heappush(heap, (int(p[min(at[k] + block, len(p)) - 1]), k))
        some, back = np.unique(np.concatenate(pairs), return_inverse=True)
        yield some, np.bincount(back, np.concatenate(counts), len(some)).astype(np.int64)


def by_side(blocks, b_size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs, cut so that no A id lies in two blocks."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for p, c in blocks:
        side = p[-1] // b_size
        cut = int(np.searchsorted(p, side * b_size))
        if held and (cut or held[0][0][0] // b_size != side):
            held.append((p[:cut], c[:cut]))
            yield tuple(map(np.concatenate, zip(*held)))
            held = []
        elif cut:
            yield p[:cut], c[:cut]
        held.append((p[cut:], c[cut:]))
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def totals(slices: list[tuple[np.ndarray, np.ndarray]], b_size: int) -> list[np.ndarray]:
    """For each slice, its pairs' counts over all, twice, plus one where no pair of the A id has more."""
    out, at = [[] for _ in slices], [0] * len(slices)
    for p, c in by_side(merged(slices), b_size):
        side = p // b_size
        first = np.flatnonzero(np.append(True, side[1:] != side[:-1]))
        top = np.repeat(np.maximum.reduceat(c, first), np.diff(np.append(first, len(p))))
        coded = 2 * c + (c == top)
        for k, (own, _) in enumerate(slices):
            hi = at[k] + int(np.searchsorted(own[at[k]:], p[-1], side="right"))
            if hi > at[k]:
                out[k].append(coded[np.searchsorted(p, own[at[k]:hi])])
            at[k] = hi
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]


_NODE = "node long, radix int, pairs binary, counts binary"
_NODE_SCHEMA = pa.schema([("node", pa.int64()), ("radix", pa.int32()), ("pairs", pa.binary()), ("counts", pa.binary())])
_TOTAL = "node long, radix int, totals binary"
_TOTAL_SCHEMA = pa.schema([("node", pa.int64()), ("radix", pa.int32()), ("totals", pa.binary())])


def _streamed(batches, names: list[str]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in names))


def _slice(pairs: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(unpack(pairs)[0]), unpack(counts)[0]


def _grouped(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition("radix", "up").sortWithinPartitions("radix", "up", *order)


def count_pairs(slices: DataFrame, b_size: int, fan_in: int) -> DataFrame:
    """(node, radix, pairs, counts) -> (node, radix, totals) aligned with each slice's pairs."""

    def sums(batches):
        def rows():
            for (radix, up), own in groupby(_streamed(batches, ["radix", "up", "pairs", "counts"]), key=itemgetter(0, 1)):
                p, c = map(np.concatenate, zip(*merged([_slice(*r[2:]) for r in own])))
                yield up, radix, pack(np.diff(p, prepend=0)), pack(c)
        yield from _record_batches(rows(), _NODE_SCHEMA)

    def top(batches):
        def rows():
            for (radix, _), own in groupby(_streamed(batches, ["radix", "up", "node", "pairs", "counts"]), key=itemgetter(0, 1)):
                own = list(own)
                for r, t in zip(own, totals([_slice(*r[3:]) for r in own], b_size)):
                    yield r[2], radix, pack(t)
        yield from _record_batches(rows(), _TOTAL_SCHEMA)

    def down(batches):
        def rows():
            for (radix, _), own in groupby(_streamed(batches, ["radix", "up", "node", "pairs", "totals"]), key=itemgetter(0, 1)):
                _, _, _, pairs, known = next(own)
                pairs, known = np.cumsum(unpack(pairs)[0]), unpack(known)[0]
                for r in own:
                    yield r[2], radix, pack(known[np.searchsorted(pairs, np.cumsum(unpack(r[3])[0]))])
        yield from _record_batches(rows(), _TOTAL_SCHEMA)

    levels, n = [slices], slices.select("node").distinct().count()
    while n > fan_in:
        n = -(-n // fan_in)
        levels[-1] = levels[-1].withColumn("up", F.pmod(F.xxhash64("node"), F.lit(n)))
        levels.append(stage(_grouped(levels[-1], "node").mapInArrow(sums, _NODE), "align-merged"))
    known = _grouped(levels[-1].withColumn("up", F.lit(0).cast("long")), "node").mapInArrow(top, _TOTAL)
    for below, own in zip(levels[-2::-1], levels[:0:-1]):
        known = stage(known, "align-totals")
        parents = own.select("node", "radix", "pairs").join(known, ["node", "radix"]).select(
            "radix", F.col("node").alias("up"), F.lit(None).cast("long").alias("node"), "pairs", "totals")
        children = below.select("radix", "up", "node", "pairs", F.lit(None).cast("binary").alias("totals"))
        known = _grouped(parents.unionByName(children), "node").mapInArrow(down, _TOTAL)
    return stage(known, "align-totals")


def finish(runs: DataFrame, known: DataFrame) -> DataFrame:
    """Documents of every run with the sums over their links."""

    def run(batches):
        for _, own in groupby(_streamed(batches, ["run", "radix", "body", "totals"]), key=itemgetter(0)):
            docs = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(next(own)[2])).read_all().combine_chunks()
            best, total = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
            for _, _, body, _ in own:
                n, doc, more = unpack(body)
                coded = np.repeat(unpack(next(own)[3])[0], n)
                np.add.at(total, doc, (more + 1) * (coded >> 1))
                np.add.at(best, doc, (more + 1) * (coded & 1))
            cols = {f.name: docs.column(f.name) for f in _DOCS} | {"n_best": pa.array(best), "count_sum": pa.array(total)}
            yield from pa.table([cols[f.name] for f in _OUT], schema=_OUT).to_batches(max_chunksize=10_000)

    none = F.lit(None).cast("binary")
    rows = runs.select("run", "radix", "body", none.alias("totals")).unionByName(
        known.select(F.col("node").alias("run"), "radix", none.alias("body"), "totals"))
    dealt = rows.repartition("run").sortWithinPartitions("run", "radix", F.col("totals").isNotNull())
    return dealt.mapInArrow(run, _OUT_DDL)


def align(docs: DataFrame, spec: str, model: bytes, pattern: str, radixes: int | None = None, records: int = RUN_RECORDS,
          fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of (doc_id, text).

    ``spec`` is a byte-level BPE's JSON, ``pattern`` its splitter as a regular
    expression, ``model`` a piece tokenizer's bytes.
    """
    import sentencepiece

    b_size = sentencepiece.SentencePieceProcessor(model_proto=model).get_piece_size()
    runs = spill(docs, spec, model, pattern, radixes or shuffle_partitions(docs.sparkSession), records)
    slices = runs.where("kind = 'slice'").select(F.col("run").alias("node"), "radix", "pairs", "counts")
    return finish(runs, count_pairs(slices, b_size, fan_in))


def query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    return align(docs.select("doc_id", "text"), spec, model, public_tokenizers.PATTERN)
