"""Boosted trees with logistic loss by level-wise histograms over packed bins (M4).

Spark ML's own fit costs a walk through objects for each (row, level) and plans
of many stages for each tree.  The settings are those of its ``GBTClassifier``
and mean the same: labels -1 and 1; the first tree is fitted to them and weighs
1, every further one is fitted to 4y / (1 + exp(2 y score)) and weighs
``stepSize``; rows are drawn for each tree, features for each node; a cut gains
the variance that it removes, a leaf holds the mean; 1 / (1 + exp(-2 score)) is
the probability.  Cuts lie at approximate quantiles of all rows, midpoints where
a feature has at most ``maxBins`` values.

Rows are binned once to a byte a feature, packed in pieces of about
``ROWS_A_PIECE`` rows, feature by feature, and staged.  The workers keep them, with
scores, targets and nodes, in files of their own (``pieces``); a level is one job: a
task adds its pieces' sums by (node, feature, bin) in one array, the sums are
shuffled by node, and the best cut of every node comes to the driver, where a
tree is an array in heap order (children of i: 2i+1, 2i+2).  What is shuffled is
bounded by tasks x nodes x features x bins and not by rows; the sums of a level
that take up to ``DRIVER_BYTES`` in all tasks together are added by the driver,
and then of two children only the one with fewer rows is summed.  A job
carries the last ``ROUNDS_A_CHAIN`` trees, from which scores are stepped on.

Targets are fixed point, so sums do not depend on the order of pieces; draws are
hashes of (piece, row, round), so a retried task draws the same.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark import RDD
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impressa.operators import forests, pieces
from impressa.operators.pieces import Tree
from impressa.sources.events import task_count
from impressa.sources.sinks import stage

ROWS_A_PIECE = 65_536
ROUNDS_A_CHAIN = 2
DRIVER_BYTES = 32 << 20  # sums of a level that the driver adds up itself, which saves a stage
SCALE = float(1 << 30)


def _ends(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The node in which each row of ``bins`` (features x rows) ends."""
    return pieces.ends(bins, np.arange(bins.shape[1]), Tree(feature, cut, cut))


def _pack(batches, width: int):
    """One row a piece: its labels, and its bins feature by feature."""
    import pyarrow as pa

    for _, labels, bins in forests._pieces(batches, width, ROWS_A_PIECE):
        out = [labels.astype(np.uint8).tobytes(), np.ascontiguousarray(bins.T).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in out], names=["labels", "bins"])


def _unpack(row) -> tuple:
    """(piece, labels, bins, scores)"""
    labels = np.frombuffer(row["labels"], np.uint8)
    return row["piece"], labels, np.frombuffer(row["bins"], np.uint8).reshape(-1, len(labels)), np.zeros(len(labels))


def drawn_rows(piece: int, n: int, seed: int, tree: int, share: float) -> np.ndarray:
    """Whether ``tree`` takes each row of a piece."""
    ids = forests._mix(np.arange(n, dtype=np.uint64) + forests._mix(np.array([piece + 1], np.uint64)))
    return (forests._mix(ids ^ forests._salt(seed, tree)) >> np.uint64(11)) < share * 2.0**53


def targets(labels: np.ndarray, score: np.ndarray, tree: int) -> np.ndarray:
    """What round ``tree`` is fitted to, in fixed point."""
    y = 2.0 * labels - 1.0
    with np.errstate(over="ignore"):
        return np.rint((4.0 * y / (1.0 + np.exp(2.0 * y * score)) if tree else y) * SCALE)


def _step(parts, trees: list[Tree], p: BoostedTrees, tree: int):
    """(piece, labels, bins, scores, targets, drawn) for round ``tree``: the values of ``trees`` are added to the scores."""
    for piece, labels, bins, score, *_ in parts:
        for t in trees:
            score = score + t.value[_ends(bins, t.feature, t.cut)]
        yield piece, labels, bins, score, targets(labels, score, tree), drawn_rows(piece, len(labels), p.seed, tree, p.subsamplingRate)


def _sums(parts, nodes: np.ndarray, feature: np.ndarray, cut: np.ndarray, cells: int):
    """(node, sums) of one task: rows and targets by feature and bin, from what ``_step`` gives."""
    def views():
        for _, _, bins, _, target, drawn in parts:
            rows = np.flatnonzero(drawn)
            yield bins, None, rows, pieces.ends(bins, rows, Tree(feature, cut, cut)), [target[rows]]

    return pieces.add_up(views(), nodes, len(feature), cells)


def best_cut(sums: np.ndarray, features: np.ndarray, least: float, gain: float) -> tuple:
    """(rows, sum, feature or -1, cut, rows left, sum left) of one node; ties go to the first feature, then the lowest cut."""
    n, s = int(sums[0, 0].sum()), int(sums[1, 0].sum())
    left = sums[:, features].cumsum(axis=2)[:, :, :-1]
    nl, nr = left[0], n - left[0]
    sl, sr = left[1] / SCALE, (s - left[1]) / SCALE
    removed = (sl * sl / np.maximum(nl, 1) + sr * sr / np.maximum(nr, 1) - (s / SCALE) ** 2 / max(n, 1)) / max(n, 1)
    removed = np.where((nl >= least) & (nr >= least) & (removed >= gain), removed, 0.0)
    f, c = divmod(int(removed.argmax()), removed.shape[1])
    if removed[f, c] <= 0:
        return n, s, -1, 0, 0, 0
    return n, s, int(features[f]), c, int(left[0, f, c]), int(left[1, f, c])


@dataclass
class BoostedModel:
    cuts: list[np.ndarray]
    trees: list[Tree]

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probability``: a vector of both classes' probabilities, from the vector ``features``."""
        cuts, trees = self.cuts, self.trees

        @F.arrow_udf("double")
        def positive(x):
            import pyarrow as pa

            score = np.zeros(len(x))
            if len(x):
                bins = np.ascontiguousarray(forests._bins(forests._matrix(x), cuts).T)
                for t in trees:
                    score = score + t.value[_ends(bins, t.feature, t.cut)]
            with np.errstate(over="ignore"):
                return pa.array(1.0 / (1.0 + np.exp(-2.0 * score)))

        p = df.withColumn("_p", positive(vector_to_array("features")))
        return p.withColumn("probability", array_to_vector(F.array(1.0 - F.col("_p"), F.col("_p")))).drop("_p")


@dataclass(frozen=True)
class BoostedTrees:
    """Settings by the names of Spark ML's ``GBTClassifier``; ``fit`` reads ``label`` (0 or 1) and the vector ``features``."""

    maxIter: int = 20
    maxDepth: int = 5
    maxBins: int = 32
    stepSize: float = 0.1
    subsamplingRate: float = 1.0
    featureSubsetStrategy: str = "all"
    minInstancesPerNode: int = 1
    minInfoGain: float = 0.0
    minWeightFractionPerNode: float = 0.0
    seed: int = 42

    def __post_init__(self):
        if not (self.featureSubsetStrategy == "all" or 0 < float(self.featureSubsetStrategy) <= 1):
            raise ValueError(f"not offered: {self.featureSubsetStrategy}")
        if not (self.maxIter > 0 and 0 <= self.maxDepth <= forests.MAX_DEPTH and 2 <= self.maxBins <= 256 and self.minInstancesPerNode > 0
                and 0 < self.stepSize <= 1 and 0 < self.subsamplingRate <= 1 and self.minInfoGain >= 0 and 0 <= self.minWeightFractionPerNode < 0.5):
            raise ValueError(f"out of range: {self}")

    def drawn_features(self, features: int) -> int:
        return features if self.featureSubsetStrategy == "all" else math.ceil(float(self.featureSubsetStrategy) * features)

    def pieces(self, train: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
        """(piece, labels, bins): packed rows dealt into even tasks, staged, so that every round reads the same pieces."""
        rows = forests.packed_rows(train, cuts).repartition(task_count(train))
        packed = rows.mapInArrow(lambda batches: _pack(batches, len(cuts)), "labels binary, bins binary")
        return stage(packed.withColumn("piece", F.monotonically_increasing_id()), "boost-pieces")

    def fit(self, train: DataFrame) -> BoostedModel:
        first = train.select(F.size(vector_to_array("features")).alias("n")).first()
        if first is None:
            raise ValueError("no rows to fit on")
        x = train.select("label", vector_to_array("features").alias("x"))
        cuts = forests.find_cuts(x, first["n"], self.maxBins)
        packed = self.pieces(x, cuts)
        rows = packed.agg(F.sum(F.octet_length("labels"))).first()[0]
        # tasks hold no rows, so one a core is enough, and their sums are fewest
        dealt = packed.repartition(packed.sparkSession.sparkContext.defaultParallelism)
        return self.boost(dealt.rdd.map(_unpack), cuts, max(self.minInstancesPerNode, self.minWeightFractionPerNode * rows))

    def boost(self, source: RDD, cuts: list[np.ndarray], least: float) -> BoostedModel:
        """All trees, one after the other; a child of a cut keeps ``least`` rows."""
        p = self

        def step(piece, tree, labels, score):
            rows = np.flatnonzero(drawn_rows(piece, len(labels), p.seed, tree, p.subsamplingRate)).astype(np.int32)
            return rows, [targets(labels, score, tree)[rows]]

        kept = pieces.Pieces(source.map(lambda row: row[:3]), step, self.maxBins, self.maxDepth, np.float64, ROUNDS_A_CHAIN, 2 * 8 * len(cuts) * self.maxBins)
        try:
            for tree in range(self.maxIter):
                kept.trees.append(self.grow(kept, tree, len(cuts), least))
        finally:
            kept.close()
        return BoostedModel(cuts, kept.trees)

    def grow(self, rows: pieces.Pieces, tree: int, width: int, least: float) -> Tree:
        """One tree, a job a level."""
        p, size, take = self, (2 << self.maxDepth) - 1, self.drawn_features(width)
        feature, cut, value = np.full(size, -1, np.int16), np.zeros(size, np.uint8), np.zeros(size)
        weight = self.stepSize if tree else 1.0

        def best(node, total):
            return best_cut(total, forests.drawn(p.seed, tree, np.array([node]), width, take)[0], least, p.minInfoGain)

        nodes, count, above = np.zeros(1, np.int64), {}, {}
        for depth in range(max(1, self.maxDepth)):
            found, above = rows.level(nodes, count, above, Tree(feature.copy(), cut.copy(), value[:0]), depth, best, DRIVER_BYTES)
            ahead, count = [], {}
            for node, (n, s, f, c, nl, sl) in found:
                if node == 0:
                    value[0] = weight * s / SCALE / max(n, 1)
                if f < 0 or depth == self.maxDepth:
                    continue
                feature[node], cut[node] = f, c
                for child, k, total in ((2 * node + 1, nl, sl), (2 * node + 2, n - nl, s - sl)):
                    value[child], count[child] = weight * total / SCALE / max(k, 1), k
                    if k >= 2 * least:
                        ahead.append(child)
            nodes = np.array(sorted(ahead), np.int64)
            if not len(nodes):
                break
        return Tree(feature, cut, value)
