"""Token counts from a tokenizer compiled to finite-state transducers.

A byte-level BPE tokenizer is two machines in a row.

* The splitter cuts text into pretokens.  Whether one begins at a character
  depends on the kinds of at most three characters around it, so it is a
  window automaton over character kinds; the kinds are read off the
  tokenizer's own splitter, block by block, as characters occur.
* The merger is a deterministic transducer over bytes that a pretoken's start
  resets.  Its state after some bytes is the last token of their encoding and
  all the tokens that may still grow over the end; two tokens may stand side
  by side if no merge across their border comes before the merges that build
  them.  A transition carries the change in the number of tokens (+1, 0 or
  less, as a byte may close up several tokens), so the changes add up to the
  count and no token is ever made.  States are determinised when first
  reached, and kept in a hash table of transitions.

Texts are cut into chunks.  All chunks of a batch run side by side, one byte a
step, from their first reset on: from there neither the state at the end nor
the count depends on what came before.  So a chunk's map from state to (state,
count) is its head (the bytes before that reset) and two constants, or its
bytes alone where a pretoken spans it.  Maps compose associatively and a
parallel prefix scan composes them; a head runs when a known state comes to
its left.

Defined results: null text counts as empty; empty text has 0 tokens.  Added
tokens in a text count as one token each, as the library does by default.
Rows repeat as they come.  Tokenizers of another make (normalisers, other
splitters, unknown tokens, stripping added tokens) raise.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from impressa.llm.common import text_bytes

CHUNK = 256
BATCH_BYTES = 4 << 20
#: A worker starts its transducer anew beyond so many states; a bound on memory, not on texts.
MAX_STATES = 1 << 18
#: A liveness test looks at so many tokens; past that a hypothesis counts as alive, which only costs states.
PROBE = 256
FEW = 24
LETTER, NUMBER, BLANK, SPACE, OTHER = range(5)
SHORT_ENDINGS, LONG_ENDINGS = "stmd", ("re", "ve", "ll")
ROOT = 0
_MULT = np.uint64(0x9E3779B97F4A7C15)


def byte_of_symbol() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for.

    Printable Latin-1 stands for itself; other bytes take the code points from 256 on, in order.
    """
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merger:
    """The BPE transducer, determinised on demand."""

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        singles = [bytes([b]) for b in range(256)]
        ids = {t: i for i, t in enumerate(singles)}
        self.rank: dict[tuple[int, int], int] = {}
        made = [-1] * 256
        parts: list[tuple[int, int] | None] = [None] * 256
        for r, (a, b) in enumerate(merges):
            if a not in ids or b not in ids or a + b in ids:
                raise ValueError("merges must build each token once, from tokens built before")
            ids[a + b] = len(parts)
            self.rank[ids[a], ids[b]] = r
            parts.append((ids[a], ids[b]))
            made.append(r)
        never = len(merges)
        # pieces at a token's edges over time, each with the rank of the merge that takes it up
        self.ends: list[list[tuple[int, int]]] = []
        self.starts: list[list[tuple[int, int]]] = []
        self.sound: list[bool] = []
        for t, p in enumerate(parts):
            if p is None:
                self.ends.append([(t, never)])
                self.starts.append([(t, never)])
                self.sound.append(True)
                continue
            a, b = p
            self.ends.append([*self.ends[b][:-1], (b, made[t]), (t, never)])
            self.starts.append([*self.starts[a][:-1], (a, made[t]), (t, never)])
            self.sound.append(self.sound[a] and self.sound[b] and not self._crosses(a, b, but=made[t]))
        tokens = sorted((w, t) for w, t in ids.items() if self.sound[t])
        self.order = [t for _, t in tokens]
        self.child: dict[int, int] = {}
        self.token, self.low, self.high = [-1], [0], [len(tokens)]
        for i, (w, t) in enumerate(tokens):
            node = 0
            for b in w:
                key = node << 8 | b
                nxt = self.child.get(key)
                if nxt is None:
                    nxt = self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.low.append(i)
                    self.high.append(i)
                node = nxt
                self.high[node] = i + 1
            self.token[node] = t
        self.clear()

    def _crosses(self, s: int, t: int, but: int = -1) -> bool:
        """Does a merge over the border of ``s`` and ``t`` come before those that build them?  Equal ranks: leftmost first."""
        rank = self.rank
        for a, na in self.ends[s]:
            for b, nb in self.starts[t]:
                r = rank.get((a, b))
                if r is not None and r < na and r <= nb and r != but:
                    return True
        return False

    def beside(self, s: int, t: int) -> bool:
        """Token ``t`` may follow ``s``; -1 is the start of a pretoken."""
        if s < 0:
            return True
        got = self._beside.get((s, t))
        if got is None:
            got = self._beside[s, t] = not self._crosses(s, t)
        return got

    def alive(self, s: int, node: int) -> bool:
        """Some token longer than the node's bytes may follow ``s``."""
        own = self.token[node] >= 0
        n = self.high[node] - self.low[node] - own
        if n == 0 or s < 0 or n > PROBE:
            return n > 0
        got = self._alive.get((s, node))
        if got is None:
            got = self._alive[s, node] = any(self.beside(s, t) for t in self.order[self.low[node] + own:self.high[node]])
        return got

    def clear(self) -> None:
        self.states: list[tuple] = [((-1, 0, 0),)]
        self.index: dict[tuple, int] = {self.states[0]: ROOT}
        self.bits, self.used = 16, 0
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.vals = np.zeros(1 << self.bits, np.int64)
        self.known: dict[int, int] = {}
        self._beside: dict[tuple[int, int], bool] = {}
        self._alive: dict[tuple[int, int], bool] = {}

    def follow(self, state: int, byte: int) -> int:
        """The transition as ``target << 8 | change + 128``, made if it is new."""
        key = state << 8 | byte
        got = self.known.get(key)
        if got is not None:
            return got
        change, last, grown = 0, -1, []
        for s, node, c in self.states[state]:
            nxt = self.child.get(node << 8 | byte)
            if nxt is None:
                continue
            t = self.token[nxt]
            if t >= 0 and self.beside(s, t):
                change, last = c + 1, t
            if self.alive(s, nxt):
                grown.append((s, nxt, c))
        hyp = (*((s, n, c - change) for s, n, c in grown), (last, 0, 0))
        to = self.index.setdefault(hyp, len(self.states))
        if to == len(self.states):
            self.states.append(hyp)
        got = self.known[key] = to << 8 | change + 128
        self._put(key, got)
        return got

    def _put(self, key: int, val: int) -> None:
        if 2 * self.used >= len(self.keys):
            self.bits += 1
            self.keys = np.full(1 << self.bits, -1, np.int64)
            self.vals = np.zeros(1 << self.bits, np.int64)
            old, self.used = self.known, 0
            for k, v in old.items():
                if k != key:
                    self._place(k, v)
        self._place(key, val)

    def _place(self, key: int, val: int) -> None:
        mask = len(self.keys) - 1
        i = (key * int(_MULT) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
        while self.keys[i] >= 0:
            i = (i + 1) & mask
        self.keys[i], self.vals[i] = key, val
        self.used += 1

    def look_up(self, key: np.ndarray) -> np.ndarray:
        at = ((key.view(np.uint64) * _MULT) >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.keys[at]
        out = self.vals[at]
        bad = np.flatnonzero(found != key)
        mask = len(self.keys) - 1
        missing = []
        while len(bad):
            empty = found[bad] < 0
            if empty.any():
                missing.append(bad[empty])
                bad = bad[~empty]
            at[bad] = (at[bad] + 1) & mask
            found[bad] = self.keys[at[bad]]
            out[bad] = self.vals[at[bad]]
            bad = bad[found[bad] != key[bad]]
        if missing:
            new = np.concatenate(missing)
            some, back = np.unique(key[new], return_inverse=True)
            out[new] = np.array([self.follow(k >> 8, k & 255) for k in some.tolist()], np.int64)[back]
        return out

    def run(self, data: np.ndarray, reset: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray
            ) -> tuple[np.ndarray, np.ndarray]:
        """(state at the end, sum of changes) of each byte range, side by side, one byte a step."""
        state, total = state.astype(np.int64), np.zeros(len(start), np.int64)
        size = end - start
        order = np.argsort(-size, kind="stable")
        size, first, at = size[order], start[order], state[order]
        out = np.zeros(len(start), np.int64)
        live = int(np.count_nonzero(size))
        j = 0
        while live > FEW:
            p = first[:live] + j
            s = at[:live]
            s[reset[p]] = ROOT
            got = self.look_up(s << 8 | data[p])
            at[:live] = got >> 8
            out[:live] += (got & 255) - 128
            j += 1
            live = int(np.searchsorted(-size[:live], -j, side="left"))
        for i in range(live):
            lo, hi = int(first[i]) + j, int(first[i] + size[i])
            s, n = int(at[i]), int(out[i])
            known, follow = self.known, self.follow
            for b, r in zip(data[lo:hi].tolist(), reset[lo:hi].tolist()):
                if r:
                    s = ROOT
                got = known.get(s << 8 | b)
                if got is None:
                    got = follow(s, b)
                n += (got & 255) - 128
                s = got >> 8
            at[i], out[i] = s, n
        state[order], total[order] = at, out
        return state, total


class Maps:
    """Chunk maps, by column: the bytes of the head, whether a reset ends it, and the end state and count behind it."""

    __slots__ = ("low", "high", "fixed", "state", "count")

    def __init__(self, low, high, fixed, state, count):
        self.low, self.high, self.fixed, self.state, self.count = low, high, fixed, state, count

    def __len__(self) -> int:
        return len(self.low)

    def take(self, at) -> Maps:
        return Maps(self.low[at], self.high[at], self.fixed[at], self.state[at], self.count[at])

    def then(self, b: Maps, run) -> Maps:
        """The maps that apply these first and ``b`` next; ``b`` begins where these end."""
        state, count = b.state.copy(), b.count.copy()
        go = np.flatnonzero(self.fixed & (b.low < b.high))
        if len(go):
            ended, more = run(b.low[go], b.high[go], self.state[go])
            count[go] += more
            free = ~b.fixed[go]
            state[go[free]] = ended[free]
        same = np.flatnonzero(self.fixed & ~b.fixed & (b.low >= b.high))
        state[same] = self.state[same]
        count += np.where(self.fixed, self.count, 0)
        return Maps(self.low, np.where(self.fixed, self.high, b.high), self.fixed | b.fixed, state, count)


def prefix_scan(maps: Maps, run) -> Maps:
    """Inclusive prefix compositions: pairs first, then the scan of pairs, then what lies between."""
    n = len(maps)
    if n == 1:
        return maps
    even = np.arange(0, n - 1, 2)
    pairs = prefix_scan(maps.take(even).then(maps.take(even + 1), run), run)
    out = Maps(*(np.empty(n, getattr(maps, k).dtype) for k in Maps.__slots__))
    rest = np.arange(2, n, 2)
    between = pairs.take(rest // 2 - 1).then(maps.take(rest), run) if len(rest) else None
    for k in Maps.__slots__:
        col = getattr(out, k)
        col[even + 1] = getattr(pairs, k)
        col[0] = getattr(maps, k)[0]
        if between is not None:
            col[rest] = getattr(between, k)
    return out


class Splitter:
    """Where pretokens begin, from the kinds of neighbouring characters."""

    def __init__(self, pre_tokenizer):
        self.cut = pre_tokenizer
        self.kinds = np.full(0x110000, 255, np.uint8)

    def _probe(self, block: int) -> None:
        """Kinds of 256 code points, by where the tokenizer's splitter cuts ``1?a`` and ``!?1``."""
        chars = [c for c in range(block << 8, (block + 1) << 8) if not 0xD800 <= c < 0xE000]
        kinds = np.full(256, OTHER, np.uint8)

        def cuts(before: str, after: str) -> np.ndarray:
            text = "".join(before + chr(c) + after for c in chars)
            at = np.zeros(len(text) + 1, bool)
            at[[lo for _, (lo, _) in self.cut.pre_tokenize_str(text)]] = True
            return at[:-1].reshape(-1, 3)

        if chars:
            between, marks = cuts("1", "a"), cuts("!", "1")
            kind = np.where(~between[:, 2], LETTER, np.where(~between[:, 1], NUMBER, np.where(~marks[:, 1], OTHER, BLANK)))
            kinds[np.array(chars) & 255] = kind
        if block == 0:
            kinds[32] = SPACE
        self.kinds[block << 8:(block + 1) << 8] = kinds

    def kinds_of(self, points: np.ndarray) -> np.ndarray:
        got = self.kinds[points]
        if got.max(initial=0) == 255:
            for block in np.unique(points[got == 255] >> 8).tolist():
                self._probe(block)
            got = self.kinds[points]
        return got

    def starts(self, points: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """True where a pretoken begins; ``begin`` marks the first character of each text."""
        n = len(points)
        kind = self.kinds_of(points)
        blank = (kind == BLANK) | (kind == SPACE)
        before = np.empty(n, np.uint8)
        before[0], before[1:] = 255, kind[:-1]
        before[begin] = 255
        after_blank = (before == BLANK) | (before == SPACE)
        closed = np.ones(n, bool)  # the text ends here
        closed[:-1] = begin[1:]
        solid_next = np.zeros(n, bool)
        solid_next[:-1] = ~blank[1:]
        out = np.where(blank, ~after_blank | (solid_next & ~closed), (before != SPACE) & (before != kind))
        quote = np.flatnonzero((points == 39) & (before != OTHER) & (before != SPACE) & ~closed)
        if len(quote):
            pad = np.concatenate([points, np.zeros(3, points.dtype)])
            one = np.isin(pad[quote + 1], [ord(c) for c in SHORT_ENDINGS])
            two = np.zeros(len(quote), bool)
            for x, y in LONG_ENDINGS:
                two |= (pad[quote + 1] == ord(x)) & (pad[quote + 2] == ord(y))
            two &= ~closed[np.minimum(quote + 1, n - 1)]
            for size, hit in ((1, quote[one]), (2, quote[two])):
                for k in range(1, size + 1):
                    out[hit + k] = False
                nxt = hit + size + 1
                out[nxt[nxt < n]] = True
        return out | begin


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte position, code point) of every character of UTF-8 bytes."""
    at = np.flatnonzero((data & 0xC0) != 0x80).astype(np.int32)
    point = data[at].astype(np.int32)
    wide = np.flatnonzero(point >= 0xC0)
    if len(wide):
        pad = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
        p, lead = at[wide], point[wide]
        a, b, c = (pad[p + k] & 0x3F for k in (1, 2, 3))
        point[wide] = np.where(lead < 0xE0, (lead & 0x1F) << 6 | a,
                               np.where(lead < 0xF0, (lead & 0x0F) << 12 | a << 6 | b, (lead & 7) << 18 | a << 12 | b << 6 | c))
        np.minimum(point, 0x10FFFF, out=point)
    return at, point


class Counter:
    """Counts tokens of texts; the compiled form of one tokenizer file."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        d = json.loads(spec)
        model, pre = d["model"], d["pre_tokenizer"] or {}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if d.get("normalizer") or d.get("truncation") or d.get("padding") or model["type"] != "BPE" or not plain \
                or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("only plain byte-level BPE with the standard splitter can be compiled")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in d["added_tokens"]):
            raise ValueError("added tokens that strip or match words cannot be compiled")
        byte = byte_of_symbol()
        raw = {s: bytes(byte[c] for c in s) for s in {x for m in model["merges"] for x in (m if isinstance(m, list) else m.split(" "))}}
        self.merger = Merger([tuple(raw[x] for x in (m if isinstance(m, list) else m.split(" "))) for m in model["merges"]])
        self.splitter = Splitter(Tokenizer.from_str(spec).pre_tokenizer)
        added = sorted((t["content"].encode() for t in d["added_tokens"] if t["content"]), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, added))) if added else None

    def _texts(self, data: bytes, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes without added tokens, the sizes and document of each text between them, and how many each document holds."""
        n = len(offsets) - 1
        held = np.zeros(n, np.int64)
        if self.added is None or not self.added.search(data):
            return data, np.diff(offsets), np.arange(n), held
        pieces, sizes, docs = [], [], []
        for i in range(n):
            lo, hi = int(offsets[i]), int(offsets[i + 1])
            for m in self.added.finditer(data, lo, hi):
                pieces.append(data[lo:m.start()])
                held[i] += 1
                lo = m.end()
                sizes.append(len(pieces[-1]))
                docs.append(i)
            pieces.append(data[lo:hi])
            sizes.append(len(pieces[-1]))
            docs.append(i)
        return b"".join(pieces), np.array(sizes, np.int64), np.array(docs, np.int64), held

    def count(self, data: bytes, offsets: np.ndarray) -> np.ndarray:
        """Token counts of the texts that lie between ``offsets`` in ``data``."""
        if len(self.merger.states) > MAX_STATES:
            self.merger.clear()
        data, sizes, docs, out = self._texts(data, offsets)
        docs, sizes = docs[sizes > 0], sizes[sizes > 0]
        if not len(sizes):
            return out
        raw = np.frombuffer(data, np.uint8)
        first = np.cumsum(sizes) - sizes
        begin = np.zeros(len(raw), bool)
        begin[first] = True
        at, points = code_points(raw)
        reset = np.zeros(len(raw) + 1, bool)
        reset[at[self.splitter.starts(points, begin[at])]] = True
        chunks = -(-sizes // CHUNK)
        text = np.repeat(np.arange(len(sizes)), chunks)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        low = first[text] + nth * CHUNK
        high = np.minimum(low + CHUNK, first[text] + sizes[text])
        resets = np.append(np.flatnonzero(reset), len(raw))
        head = np.minimum(resets[np.searchsorted(resets, low)], high)
        fixed = head < high

        def run(a, b, state):
            return self.merger.run(raw, reset, a, b, state)

        state, count = np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
        go = np.flatnonzero(fixed)
        state[go], count[go] = run(head[go], high[go], np.zeros(len(go), np.int64))
        done = prefix_scan(Maps(low, head, fixed, state, count), run).count
        last = np.cumsum(chunks) - 1
        np.add.at(out, docs, np.diff(done[last], prepend=0))
        return out


_COMPILED: dict[str, Counter] = {}


def compiled(spec: str) -> Counter:
    """One compiled form a process, kept over batches and tasks."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = Counter(spec)
    return _COMPILED[key]


def _sliced(array: pa.Array) -> Iterator[tuple[bytes, np.ndarray]]:
    """(bytes, offsets) of runs of rows of about ``BATCH_BYTES``."""
    array = array.cast(pa.large_binary())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset:array.offset + len(array) + 1]
    data = array.buffers()[2]
    lo = 0
    while lo < len(array):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BATCH_BYTES, side="right")) - 1)
        own = offsets[lo:hi + 1]
        size = int(own[-1] - own[0])
        yield (data.slice(int(own[0]), size).to_pybytes() if size else b""), own - own[0]
        lo = hi


def token_count(spark: SparkSession, path: str):
    """A column function: UTF-8 bytes to token counts by the tokenizer file at ``path``, read on the driver."""
    with open(path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = compiled(spec.value)
        for array in batches:
            yield pa.array(np.concatenate([counter.count(*x) for x in _sliced(array)] or [np.zeros(0, np.int64)]), pa.int64())

    return count


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 1024, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and n_bytes, n_tokens, over_limit of every whole text."""
    size: Column = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    counted = docs.select(*keep, size.alias("n_bytes"), token_count(docs.sparkSession, path)(text_bytes(text)).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return count_tokens(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), public_tokenizers.path("byte_bpe_50k.json"))
