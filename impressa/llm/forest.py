"""Embedding near-duplicates by a random-projection tree forest (operator 9).

Trees split recursively on random directions at the median; vectors within
``spill`` of a split go both ways.  The spill is narrow: a split parts about one
in fifty of the pairs at the threshold, so a tree of 14 levels loses a quarter of
these (fewer of closer pairs) and all trees together about one in ten thousand,
while only one vector in sixteen is copied at a split.  (A spill that loses no
pair copies a quarter, and copies grow with every level.)

The upper part of a tree is fitted on a bounded sample (``sample`` distinct vectors
of smallest hash) and every vector is routed through it.  A leaf that then holds
too many vectors of a label is refitted on a bounded sample of its own, by the
task that has this sample, and its vectors are routed on in chunks, until no leaf
is too large or no split divides it; so the work a vector does not grow with the table.
Only vectors of one label that share a leaf are compared, by exact
double-precision cosine; a dense group that no split divides is compared in
chunk pairs of bounded size.

Equal vectors of a label are one node with a multiplicity, so copies are never
expanded.  A pair that shares several leaves counts in its first one only, so a
leaf returns link counts and one root per linked vector, and no pairs.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components, or have a null label, link with nothing (n_links 0, their own
component); vectors of different lengths do not link; every row counts as a
vector, also when its id is repeated or null (a null id names no component and
is never kept); an empty table gives no rows; other columns are not returned.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impressa.llm.common import run_labels
from impressa.llm.components import connected_components
from impressa.sources.sinks import stage

TREES = 6
LEAF = 1500
SAMPLE = 20_000
#: Width of the overlap at a split, in standard deviations of the gap of a pair at the threshold.
SPILL_SIGMAS = 0.8
MAX_DEPTH = 24
#: Vectors that a leaf is refitted on, and that are routed on together.
SUBSAMPLE = 4_000
CHUNK = 20_000
ROUNDS = 6


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, without overflow."""
    x = x.astype(float)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Tree:
    """Split directions and medians; leaves are numbered from ``first``."""

    def __init__(self, x: np.ndarray, label: np.ndarray, scale: float, leaf: int, spill: float, rng, first: int):
        self.spill, self.nodes, self.next = spill, [], first
        self._grow(x, label, scale, leaf, rng, MAX_DEPTH)

    def _grow(self, x, label, scale, leaf, rng, depth) -> int:
        at = len(self.nodes)
        self.nodes.append(None)
        fullest = np.unique(label, return_counts=True)[1].max() if len(label) else 0
        if depth and fullest > 8 and fullest * scale > leaf:
            for _ in range(3):
                r = rng.standard_normal(x.shape[1])
                r /= np.linalg.norm(r)
                p = x @ r
                cut = np.median(p)
                left, right = p <= cut + self.spill, p >= cut - self.spill
                if max(left.mean(), right.mean()) < 0.85:
                    a = self._grow(x[left], label[left], scale, leaf, rng, depth - 1)
                    b = self._grow(x[right], label[right], scale, leaf, rng, depth - 1)
                    self.nodes[at] = (r, cut, a, b)
                    return at
        self.nodes[at] = self.next
        self.next += 1
        return at

    def route(self, x: np.ndarray, rows: np.ndarray | None = None, at: int = 0):
        """(rows, leaf) for every leaf reached."""
        rows = np.arange(len(x)) if rows is None else rows
        if not len(rows):
            return
        node = self.nodes[at]
        if isinstance(node, tuple):
            r, cut, a, b = node
            p = x[rows] @ r
            yield from self.route(x, rows[p <= cut + self.spill], a)
            yield from self.route(x, rows[p >= cut - self.spill], b)
        else:
            yield rows, node


def spill(dim: int, threshold: float) -> float:
    """Half the overlap: a part of the deviation that the gap of a pair at the threshold has along a random direction."""
    return SPILL_SIGMAS * float(np.sqrt(max(0.0, 2 - 2 * threshold) / dim)) / 2


def grow(x: np.ndarray, label: np.ndarray, total: int, threshold: float, trees: int, leaf: int, seed: int) -> list[Tree]:
    rng, out, first = np.random.default_rng(seed), [], 0
    for _ in range(trees):
        t = Tree(x, label, max(1.0, total / len(x)), leaf, spill(x.shape[1], threshold), rng, first)
        first = t.next
        out.append(t)
    return out


def common_before(sig: np.ndarray, a: np.ndarray, b: np.ndarray, leaf: int) -> np.ndarray:
    """Whether rows a and b of ``sig`` (leaf numbers, padded with -1) share a leaf below ``leaf``."""
    out = np.zeros(len(a), bool)
    for c in range(sig.shape[1]):
        own = sig[a, c]
        out |= ((own[:, None] == sig[b]).any(1)) & (own >= 0) & (own < leaf)
    return out


def compare(x, mult, sig, leaf: int, threshold: float, side: np.ndarray | None):
    """Link counts of each row and a root for each; with ``side``, only pairs across the two sides."""
    n = len(x)
    links, us, vs = np.zeros(n, np.int64), [], []
    rows = np.flatnonzero(~side) if side is not None else np.arange(n)
    cols = np.flatnonzero(side) if side is not None else rows
    for i in range(0, len(rows), 256):
        part = rows[i:i + 256]
        a, b = np.nonzero(x[part] @ x[cols].T >= threshold)
        a, b = part[a], cols[b]
        if side is None:
            a, b = a[a < b], b[a < b]
        for j in range(0, len(a), 100_000):
            p, q = a[j:j + 100_000], b[j:j + 100_000]
            new = ~common_before(sig, p, q, leaf)
            p, q = p[new], q[new]
            links += np.bincount(p, mult[q], n).astype(np.int64) + np.bincount(q, mult[p], n).astype(np.int64)
            us.append(p)
            vs.append(q)
    u, v = (np.concatenate(z) if z else np.empty(0, np.int64) for z in (us, vs))
    return links, run_labels(n, u, v)


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, seed: int = 5) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    e = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda v: F.coalesce(F.abs(v.cast("double")) <= F.lit(1.7976931348623157e308), F.lit(False)))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda v: v != 0), F.lit(False))
    v = vectors.select("vec_id", "label", "embedding").withColumn("node", F.when(usable, F.xxhash64(F.col("label").cast("string"), "embedding")))
    v = stage(v.select("vec_id", "node", F.col("label").cast("string").alias("label"), F.when(usable, e).alias("x")), "forest-vectors")
    nodes = stage(v.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("first"), F.count("*").alias("mult"), F.first("label").alias("label"), F.first("x").alias("x")),
                  "forest-nodes").withColumn("d", F.size("x"))
    out, edges = None, None
    for dim in [r[0] for r in nodes.select("d").distinct().collect()]:
        own = nodes.where(F.col("d") == dim)
        counts, found = _search(spark, own, np.float32 if single else np.float64, threshold, trees, leaf, sample, seed)
        out = counts if out is None else out.unionByName(counts)
        edges = found if edges is None else edges.unionByName(found)
    if out is None:
        return v.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    counts = out.groupBy("node").agg(F.sum("n").alias("n"))
    roots = connected_components(edges)
    n = nodes.select("node", "first", "mult").join(counts, "node", "left").join(roots, "node", "left").withColumn("class", F.coalesce("root", "node"))
    least = n.groupBy("class").agg(F.min("first").alias("component_id"))
    n = n.join(least, "class").select("node", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n"), "component_id")
    rows = v.select("vec_id", "node")
    linked = rows.where("node is not null").join(n, "node").select("vec_id", F.col("n").cast("long").alias("n_links"), F.col("component_id").cast("long"))
    alone = rows.where("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


_ROUTED = "node long, label string, mult long, leaf long, data binary, sig array<long>"


def refined(routed: DataFrame, kind, threshold: float, leaf: int, seed: int) -> DataFrame:
    """``routed`` with leaves of over 2 x ``leaf`` vectors of a label split further, and ``sig`` telling all leaves of a vector."""
    changed = False
    for level in range(ROUNDS):
        size = routed.groupBy("label", "leaf").count()
        big = stage(size.where(F.col("count") > 2 * leaf), "forest-large")
        if big.isEmpty():
            break
        drawn = F.pmod(F.xxhash64("node", F.lit(seed + level)), F.col("count")) < SUBSAMPLE

        def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            x = unit(np.frombuffer(b"".join(pdf["data"]), kind).reshape(len(pdf), -1))
            rng = np.random.default_rng([seed, level, key[1] & 0x7FFFFFFF])
            t = Tree(x, np.zeros(len(x), np.int8), max(1.0, pdf["count"].iloc[0] / len(x)), leaf, spill(x.shape[1], threshold), rng, 0)
            if t.next == 1:
                return pd.DataFrame({"label": np.empty(0, object), "leaf": np.empty(0, np.int64), "tree": np.empty(0, object)})
            return pd.DataFrame({"label": [key[0]], "leaf": [key[1]], "tree": [pickle.dumps(t)]})

        sample = routed.join(big, ["label", "leaf"]).where(drawn).select("label", "leaf", "count", "data")
        trees = stage(sample.groupBy("label", "leaf").applyInPandas(fit, "label string, leaf long, tree binary"), "forest-trees")
        split = trees.join(big, ["label", "leaf"]).withColumn("chunks", F.ceil(F.col("count") / CHUNK).cast("int"))
        if trees.isEmpty():
            break

        def on(rows: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
            x = unit(np.frombuffer(b"".join(rows["data"]), kind).reshape(len(rows), -1)) if len(rows) else None
            if x is None:
                return rows[_NAMES]
            parts = [(r, np.full(len(r), at)) for r, at in pickle.loads(tree["tree"].iloc[0]).route(x)]
            out = rows[_NAMES].iloc[np.concatenate([r for r, _ in parts])].copy()
            # leaves below a leaf: its number mixed with theirs, clear of the first trees' small numbers
            above, own = out["leaf"].to_numpy().astype(np.uint64), np.concatenate([a for _, a in parts]).astype(np.uint64)
            h = (above * np.uint64(0x9E3779B97F4A7C15) + own + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
            out["leaf"] = ((h ^ (h >> np.uint64(29))) >> np.uint64(2) | np.uint64(1 << 61)).astype(np.int64)
            return out

        places = split.select("label", "leaf", "chunks")
        moved = routed.join(places, ["label", "leaf"]).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
        by = split.select("label", "leaf", "tree", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        keys = ["label", "leaf", "chunk"]
        moved = moved.groupBy(*keys).cogroup(by.groupBy(*keys)).applyInPandas(on, _ROUTED)
        routed = stage(routed.join(places, ["label", "leaf"], "left_anti").unionByName(moved), "forest-routed")
        changed = True
    if not changed:
        return routed
    sigs = routed.groupBy("node").agg(F.sort_array(F.collect_set("leaf")).alias("sig"))
    return stage(routed.drop("sig").join(sigs, "node").select("node", "label", "mult", "leaf", "data", "sig"), "forest-routed")


_NAMES = [c.split()[0] for c in _ROUTED.split(", ")]


def _search(spark, nodes: DataFrame, kind, threshold, trees, leaf, sample, seed) -> tuple[DataFrame, DataFrame]:
    """(node, n) link counts by leaf and (a, b) links, for nodes of one dimension."""
    total = nodes.count()
    got = nodes.select("label", "x", "node").orderBy("node").limit(sample).collect()
    x = unit(np.array([r["x"] for r in got], float))
    label = np.unique([r["label"] for r in got], return_inverse=True)[1]
    forest = spark.sparkContext.broadcast(grow(x, label, total, threshold, trees, leaf, seed))

    def route(batches):
        for b in batches:
            m = b.num_rows
            if not m:
                continue
            raw = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(m, -1)
            z = unit(raw)
            rows, leaves = [], []
            for t in forest.value:
                for r, at in t.route(z):
                    rows.append(r)
                    leaves.append(np.full(len(r), at, np.int64))
            rows, leaves = np.concatenate(rows), np.concatenate(leaves)
            order = np.lexsort((leaves, rows))
            sig = np.split(leaves[order], np.cumsum(np.bincount(rows, minlength=m))[:-1])
            data = [raw[i].tobytes() for i in range(m)]
            for i in range(0, len(rows), 20_000):
                r = rows[i:i + 20_000]
                take = pa.array(r)
                yield pa.RecordBatch.from_arrays(
                    [b.column("node").take(take), b.column("label").take(take), b.column("mult").take(take), pa.array(leaves[i:i + 20_000]),
                     pa.array([data[j] for j in r], pa.binary()), pa.array([sig[j] for j in r], pa.list_(pa.int64()))],
                    ["node", "label", "mult", "leaf", "data", "sig"])

    routed = nodes.select("node", "label", "mult", "x").mapInArrow(route, _ROUTED)
    routed = refined(stage(routed, "forest-routed"), kind, threshold, leaf, seed)
    size = routed.groupBy("label", "leaf").count()
    chunks = size.select("label", "leaf", F.ceil(F.col("count") / (2 * leaf)).cast("int").alias("k")).where("k > 1")
    r = routed.join(chunks, ["label", "leaf"], "left").withColumn("k", F.coalesce("k", F.lit(1)))
    r = r.withColumn("own", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    r = r.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    r = r.select("label", "leaf", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "mult", "data", "sig")

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, at, i, j = key
        z = unit(np.frombuffer(b"".join(pdf["data"]), kind).reshape(len(pdf), -1))
        sigs = [np.asarray(s, np.int64) for s in pdf["sig"]]
        sig = np.full((len(sigs), max(map(len, sigs))), -1, np.int64)
        for n, s in enumerate(sigs):
            sig[n, :len(s)] = s
        side = None if i == j else (pdf["own"] == j).to_numpy()
        links, lab = compare(z, pdf["mult"].to_numpy(), sig, int(at), threshold, side)
        on = np.flatnonzero(links)
        node = pdf["node"].to_numpy()
        return pd.DataFrame({"node": node[on], "n": links[on], "root": node[lab[on]]})

    found = stage(r.groupBy("label", "leaf", "i", "j").applyInPandas(meet, "node long, n long, root long"), "forest-links")
    return found.select("node", "n"), found.select(F.col("node").alias("a"), F.col("root").alias("b"))


def query(vectors: DataFrame) -> DataFrame:
    return near_duplicates(vectors)
