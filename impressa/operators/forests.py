"""Random forests by level-wise histograms over packed bins (M2).

Many deep trees cost Spark ML's own fit a walk through objects for each (row,
tree, level) and a histogram object for each (task, node).  The settings are those of Spark ML's ``RandomForestClassifier`` and mean the
same: Poisson(1) bootstrap of the rows for each tree, ceil(sqrt(features))
features drawn for each node, entropy, cuts at approximate quantiles (midpoints
where a feature has at most ``maxBins`` values), leaves that hold class counts,
leaves merged that predict the same class, and the mean of the trees' class
shares as the probability.  Rows are numbered once; draws are hashes of (row
number, tree) and (tree, node, feature), so every level and every retried task
draws the same.

Rows are binned once to a byte a feature and staged.  All trees grow together,
one job a level: tasks take pieces of ``ROWS_A_PIECE`` rows and sum, tree by
tree, (node, drawn feature, bin, class) in an array of integers; the sums are
shuffled in blocks of ``NODES_A_BLOCK`` nodes, and the best cut of every node
comes to the driver, where trees are arrays in heap order (children of i:
2i+1, 2i+2).  A task holds a piece and one tree's sums, a group one block a
piece; what is shuffled is bounded by pieces x nodes x drawn features x bins.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impressa.sources.events import task_count
from impressa.sources.sinks import stage

ROWS_A_PIECE = 250_000
NODES_A_BLOCK = 64
MAX_DEPTH = 15
POISSON_BITS = 20


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of every entry (wraps around)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _salt(seed: int, tree: int) -> np.uint64:
    return _mix(np.array([(seed * 1_000_003 + tree + 1) & (2**64 - 1)], np.uint64))[0]


def poisson_table() -> np.ndarray:
    """Poisson(1) draws by the first ``POISSON_BITS`` bits of a hash."""
    share = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(share, (np.arange(1 << POISSON_BITS) + 0.5) / (1 << POISSON_BITS)).astype(np.uint8)


def bag(mixed: np.ndarray, seed: int, tree: int, table: np.ndarray) -> np.ndarray:
    """How often ``tree`` takes each row; ``mixed``: mixed row numbers."""
    return table[_mix(mixed ^ _salt(seed, tree)) >> np.uint64(64 - POISSON_BITS)]


def drawn(seed: int, tree: int, nodes: np.ndarray, features: int, take: int) -> np.ndarray:
    """The ``take`` features (ascending) that each of ``nodes`` may be cut by."""
    at = _mix(nodes.astype(np.uint64)[:, None] * np.uint64(features) + np.arange(features, dtype=np.uint64) + np.uint64(1))
    order = np.argpartition(_mix(at ^ _salt(~seed, tree)), take - 1, axis=1)
    return np.sort(order[:, :take], axis=1)


def _matrix(column) -> np.ndarray:
    """An Arrow column of equally long lists as rows x entries."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bins of values: how many cuts of its feature lie below a value."""
    out = np.empty(x.shape, np.uint8)
    for f, at in enumerate(cuts):
        out[:, f] = np.searchsorted(at, x[:, f], side="left")
    return out


def _walk(bins: np.ndarray, rows: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The node of one tree in which each of ``rows`` ends."""
    width, flat = bins.shape[1], bins.reshape(-1)
    at = np.zeros(len(rows), np.int64)
    todo = np.arange(len(rows)) if feature[0] >= 0 else np.empty(0, np.int64)
    while len(todo):
        k = at[todo]
        k = 2 * k + 1 + (flat[rows[todo] * width + feature[k]] > cut[k])
        at[todo] = k
        todo = todo[feature[k] >= 0]
    return at


def _distinct(batches, features: int, most: int):
    """(f, value): up to ``most`` values that a task sees of each feature."""
    import pyarrow as pa

    seen = [np.empty(0)] * features
    for batch in batches:
        x = _matrix(batch.column("x"))
        for f in range(features if len(x) else 0):
            if len(seen[f]) < most:
                seen[f] = np.union1d(seen[f], x[:, f])[:most]
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(features, dtype=np.int32), [len(s) for s in seen])),
                                      pa.array(np.concatenate(seen))], names=["f", "value"])


def find_cuts(x: DataFrame, features: int, bins: int, accuracy: int = 10_000) -> list[np.ndarray]:
    """Cuts of every feature of the array ``x``: midpoints between its values if these are at most ``bins``, else its k/``bins`` quantiles."""
    values = x.mapInArrow(lambda batches: _distinct(batches, features, bins + 1), "f int, value double")
    few = {r["f"]: r["v"] for r in values.groupBy("f").agg(F.slice(F.array_sort(F.collect_set("value")), 1, bins + 1).alias("v")).collect()}
    many = [f for f in range(features) if len(few.get(f, [])) > bins]
    cuts = [(v[1:] + v[:-1]) / 2 for v in (np.array(few.get(f, []), float) for f in range(features))]
    if many:
        at = [k / bins for k in range(1, bins)]
        # a group a feature, so that the tasks' sketches are merged side by side
        one = x.select(F.posexplode("x").alias("f", "value")).where(F.col("f").isin(many))
        for r in one.groupBy("f").agg(F.percentile_approx("value", at, accuracy).alias("q")).collect():
            cuts[r["f"]] = np.unique(np.array(r["q"], float))
    return cuts


def packed_rows(train: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """(id, label, bins): the rows of (label, x) numbered, with a byte for the bin of each feature."""
    @F.arrow_udf("binary")
    def packed(x):
        import pyarrow as pa

        bins = _bins(_matrix(x), cuts) if len(x) else np.empty((0, len(cuts)), np.uint8)
        ends = (np.arange(len(x) + 1) * len(cuts)).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(bins.tobytes())])

    label = F.when(F.col("label").isin(0, 1), F.col("label").cast("tinyint")).otherwise(F.raise_error(F.lit("a label is neither 0 nor 1")).cast("tinyint"))
    return train.select(F.monotonically_increasing_id().alias("id"), label.alias("label"), packed(F.col("x")).alias("bins"))


def _pieces(batches, width: int, most: int = ROWS_A_PIECE):
    """(row numbers, labels, bins) of up to about ``most`` rows at a time."""
    kept, n = [], 0

    def piece():
        ids, labels, bins = (np.concatenate(c) for c in zip(*kept))
        return ids, labels, bins

    for batch in batches:
        if not batch.num_rows:
            continue
        packed = batch.column("bins")
        first = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset]
        bins = np.frombuffer(packed.buffers()[2], np.uint8, len(packed) * width, first).reshape(-1, width)
        kept.append((batch.column("id").to_numpy().astype(np.uint64), batch.column("label").to_numpy().astype(np.int64), bins.copy()))
        n += batch.num_rows
        if n >= most:
            yield piece()
            kept, n = [], 0
    if kept:
        yield piece()


def _sums(batches, active: dict[int, np.ndarray], feature: np.ndarray, cut: np.ndarray, p: RandomForest, width: int):
    """(tree, block, size, sums): class counts of one level, as integers of ``size`` bytes by node, drawn feature, bin and class."""
    import pyarrow as pa

    table, take, cells = poisson_table(), p.drawn_features(width), 2 * p.maxBins
    for ids, labels, bins in _pieces(batches, width):
        mixed, flat = _mix(ids), bins.reshape(-1)
        for tree, nodes in active.items():
            times = bag(mixed, p.seed, tree, table)
            rows = np.flatnonzero(times)
            place = np.full(feature.shape[1], -1, np.int64)
            place[nodes] = np.arange(len(nodes))
            slot = place[_walk(bins, rows, feature[tree], cut[tree])]
            own = slot >= 0
            rows, slot = rows[own], slot[own]
            if not len(rows):
                continue
            times = times[rows].astype(float)
            key, at, of = slot * cells + labels[rows], rows * width, drawn(p.seed, tree, nodes, width, take)
            sums = np.empty((len(nodes), take, cells), np.int64)
            for s in range(take):
                b = flat[at + of[:, s][slot]].astype(np.int64)
                sums[:, s] = np.bincount(key + 2 * b, times, len(nodes) * cells).reshape(-1, cells)
            blocks = [sums[k:k + NODES_A_BLOCK] for k in range(0, len(nodes), NODES_A_BLOCK)]
            size = 1 if sums.max() < 1 << 8 else 2 if sums.max() < 1 << 16 else 4 if sums.max() < 1 << 32 else 8
            out = [pa.array([tree] * len(blocks), pa.int32()), pa.array(range(len(blocks)), pa.int32()), pa.array([size] * len(blocks), pa.int32()),
                   pa.array([b.astype(f"u{size}").tobytes() for b in blocks], pa.binary())]
            yield pa.RecordBatch.from_arrays(out, names=["tree", "block", "size", "sums"])


def _entropy(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    n = np.maximum(n0 + n1, 1)
    return sum(-(c / n) * np.log2(np.where(c > 0, c / n, 1.0)) for c in (n0, n1))


def best_cuts(sums: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """For sums by node, feature, bin and class: the totals of each node, and the place of its best feature (-1: none gains), its cut and the classes left of it."""
    all_ = sums[:, 0].sum(axis=1)
    left = sums.cumsum(axis=2)[:, :, :-1]
    right = all_[:, None, None] - left
    nl, nr = left.sum(axis=3), right.sum(axis=3)
    n = np.maximum(nl + nr, 1)
    gain = (_entropy(all_[:, 0], all_[:, 1])[:, None, None] - nl / n * _entropy(left[..., 0], left[..., 1])
            - nr / n * _entropy(right[..., 0], right[..., 1]))
    gain = np.where((nl >= least) & (nr >= least), gain, -1.0).reshape(len(sums), -1)
    best = gain.argmax(axis=1)
    row = np.arange(len(sums))
    s, c = np.divmod(best, left.shape[2])
    return all_, np.where(gain[row, best] > 0, s, -1), c, left[row, s, c]


def prune(feature: np.ndarray, counts: np.ndarray, depth: int) -> None:
    """As Spark ML does: two leaves that predict the same class (class 0 if tied) become one, from the lowest level up."""
    one = counts[..., 1] > counts[..., 0]
    for d in reversed(range(depth)):
        k = np.arange((1 << d) - 1, (2 << d) - 1)
        leaves = (feature[:, 2 * k + 1] < 0) & (feature[:, 2 * k + 2] < 0) & (one[:, 2 * k + 1] == one[:, 2 * k + 2])
        feature[:, k] = np.where(leaves, -1, feature[:, k])


FOUND = "tree int, node int, n0 bigint, n1 bigint, feature int, cut int, left0 bigint, left1 bigint"


def _best(table, active: dict[int, np.ndarray], p: RandomForest, width: int):
    import pyarrow as pa

    tree, block = table.column("tree")[0].as_py(), table.column("block")[0].as_py()
    nodes = active[tree][block * NODES_A_BLOCK:(block + 1) * NODES_A_BLOCK]
    take = p.drawn_features(width)
    total = np.zeros(len(nodes) * take * 2 * p.maxBins, np.int64)
    for size, sums in zip(table.column("size").to_pylist(), table.column("sums")):
        total += np.frombuffer(sums.as_buffer(), f"u{size}").astype(np.int64)
    all_, s, c, left = best_cuts(total.reshape(len(nodes), take, p.maxBins, 2), p.minInstancesPerNode)
    of = drawn(p.seed, tree, nodes, width, take)[np.arange(len(nodes)), np.maximum(s, 0)]
    cols = [np.full(len(nodes), tree, np.int32), nodes.astype(np.int32), all_[:, 0], all_[:, 1], np.where(s < 0, -1, of).astype(np.int32),
            c.astype(np.int32), left[:, 0], left[:, 1]]
    return pa.table([pa.array(x) for x in cols], names=[x.split()[0] for x in FOUND.split(", ")])


@dataclass
class ForestModel:
    """Trees as arrays (trees x nodes in heap order): ``feature`` (-1: a leaf), ``cut`` (its last bin to the left), ``counts`` of both classes."""

    cuts: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    counts: np.ndarray

    def shares(self) -> np.ndarray:
        return self.counts[..., 1] / np.maximum(self.counts.sum(axis=2), 1)

    def _grown(self) -> np.ndarray:
        """Trees that took a row; on a handful of rows a bootstrap may be empty."""
        return np.flatnonzero(self.counts[:, 0].sum(axis=1))

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probability``: a vector of both classes' mean share over the trees, from the vector ``features``."""
        cuts, grown = self.cuts, self._grown()
        feature, cut, share = self.feature[grown].astype(np.int16), self.cut[grown], self.shares()[grown]

        @F.arrow_udf("double")
        def positive(x):
            import pyarrow as pa

            total = np.zeros(len(x))
            if len(x):
                bins, rows = _bins(_matrix(x), cuts), np.arange(len(x))
                for tree in range(len(feature)):
                    total += share[tree][_walk(bins, rows, feature[tree], cut[tree])]
            return pa.array(total / max(1, len(feature)))

        p = df.withColumn("_p", positive(vector_to_array("features")))
        return p.withColumn("probability", array_to_vector(F.array(1.0 - F.col("_p"), F.col("_p")))).drop("_p")


@dataclass(frozen=True)
class RandomForest:
    """Settings by the names of Spark ML's ``RandomForestClassifier``; ``fit`` reads ``label`` (0 or 1) and the vector ``features``."""

    numTrees: int = 20
    maxDepth: int = 5
    maxBins: int = 32
    minInstancesPerNode: int = 1
    featureSubsetStrategy: str = "sqrt"
    impurity: str = "entropy"
    seed: int = 42

    def __post_init__(self):
        if self.featureSubsetStrategy not in ("sqrt", "all") or self.impurity != "entropy":
            raise ValueError(f"not offered: {self.featureSubsetStrategy}, {self.impurity}")
        if not (0 <= self.maxDepth <= MAX_DEPTH and 2 <= self.maxBins <= 256 and self.numTrees > 0 and self.minInstancesPerNode > 0):
            raise ValueError(f"out of range: {self}")

    def drawn_features(self, features: int) -> int:
        return features if self.featureSubsetStrategy == "all" else math.ceil(math.sqrt(features))

    def binned(self, train: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
        """(id, label, bins): rows numbered and packed, staged, so that every level reads the same numbers."""
        return stage(packed_rows(train, cuts), "forest-rows")

    def fit(self, train: DataFrame) -> ForestModel:
        first = train.select(F.size(vector_to_array("features")).alias("n")).first()
        if first is None:
            raise ValueError("no rows to fit on")
        x = train.select("label", vector_to_array("features").alias("x"))
        cuts = find_cuts(x, first["n"], self.maxBins)
        rows = self.binned(x, cuts)
        # small files would be read by few tasks; the levels read even pieces, one a core at least
        rows = rows.repartition(task_count(rows, ROWS_A_PIECE)).persist()
        try:
            return self.grow(rows, cuts)
        finally:
            rows.unpersist()

    def grow(self, rows: DataFrame, cuts: list[np.ndarray]) -> ForestModel:
        """All trees from binned rows, a job a level."""
        width, size = len(cuts), (2 << self.maxDepth) - 1
        feature, cut = np.full((self.numTrees, size), -1, np.int64), np.zeros((self.numTrees, size), np.uint8)
        counts = np.zeros((self.numTrees, size, 2), np.int64)
        active = {t: np.zeros(1, np.int64) for t in range(self.numTrees)}
        for depth in range(max(1, self.maxDepth)):
            found = self.level(rows, active, feature, cut, width)
            if not depth:
                counts[found["tree"], 0] = np.stack([found["n0"], found["n1"]], axis=1)
            if depth == self.maxDepth:
                break
            f = {k: v[found["feature"] >= 0] for k, v in found.items()}
            tree, node = f["tree"], f["node"].astype(np.int64)
            feature[tree, node], cut[tree, node] = f["feature"], f["cut"]
            left = np.stack([f["left0"], f["left1"]], axis=1)
            counts[tree, 2 * node + 1], counts[tree, 2 * node + 2] = left, counts[tree, node] - left
            trees, nodes = np.concatenate([tree, tree]), np.concatenate([2 * node + 1, 2 * node + 2])
            mixed = (counts[trees, nodes] > 0).all(axis=1)
            trees, nodes = trees[mixed], nodes[mixed]
            active = {int(t): np.sort(nodes[trees == t]) for t in np.unique(trees)}
            if not active:
                break
        prune(feature, counts, self.maxDepth)
        return ForestModel(cuts, feature, cut, counts)

    def level(self, rows: DataFrame, active: dict[int, np.ndarray], feature: np.ndarray, cut: np.ndarray, width: int) -> dict[str, np.ndarray]:
        """Totals and best cuts of the ``active`` nodes of all trees."""
        p, feature, cut = self, feature.astype(np.int16), cut.copy()
        sums = rows.mapInArrow(lambda batches: _sums(batches, active, feature, cut, p, width), "tree int, block int, size int, sums binary")
        found = sums.groupBy("tree", "block").applyInArrow(lambda table: _best(table, active, p, width), FOUND).toArrow()
        return {c: found.column(c).to_numpy() for c in found.column_names}
