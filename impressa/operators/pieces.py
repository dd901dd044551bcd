"""Packed pieces of rows that stay beside the workers, for trees that grow in many short jobs (M4).

A boosted tree costs a job a level.  Shipping every row to a Python worker for
each of them takes longer than adding it up, so a piece (labels, and a byte a
feature, feature by feature) is written once to the folder that Spark gives
every executor and clears itself, and mapped into memory by the tasks.  What a
round changes lies beside it: the scores, the rows drawn with their weights,
and the node of each at the last level.  All of it is a function of the piece
and of the trees: a task that misses a file makes it again from what its job
carries, or the job is sent again with all trees, after the pieces were read anew
from their source.
"""

from __future__ import annotations

import contextlib
import os
import shutil
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
from pyspark import RDD, SparkFiles, StorageLevel

LOST = "PieceLost"


class PieceLost(RuntimeError):
    """A file of a piece is not on this machine."""


@dataclass(frozen=True)
class Tree:
    """Nodes in heap order: ``feature`` (-1: a leaf), ``cut`` (its last bin to the left, once ``shift`` is taken off), ``value``: what a leaf adds to the score."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    shift: np.ndarray | None = None


def ends(bins: np.ndarray, rows: np.ndarray, tree: Tree, at: np.ndarray | None = None) -> np.ndarray:
    """The node of ``tree`` in which each of ``rows`` of ``bins`` (features x rows) ends, from its node ``at`` on.  A bin less its shift wraps around."""
    flat, first = bins.reshape(-1), tree.feature.astype(np.int64) * bins.shape[1]
    at = np.zeros(len(rows), np.int64) if at is None else at.astype(np.int64)
    todo, rows = np.flatnonzero(first[at] >= 0), rows.astype(np.int64, copy=False)
    while len(todo):
        k = at[todo]
        b = flat[first[k] + rows[todo]]
        k = 2 * k + 1 + ((b if tree.shift is None else b - tree.shift[k]) > tree.cut[k])
        at[todo] = k
        todo = todo[first[k] >= 0]
    return at


def paired(bins: np.ndarray, cells: int) -> np.ndarray:
    """Codes of two features at a time (an odd one is left out)."""
    even = len(bins) // 2 * 2
    return bins[0:even:2].astype(np.uint16) * np.uint16(cells) + bins[1:even:2]


def add_up(views: Iterable[tuple], nodes: np.ndarray, size: int, cells: int):
    """(node, sums) of one task: rows and weights by feature and bin, for ``nodes`` of a tree of ``size``.

    A piece's weights are integers whose sums stay under 2^53, so exact as doubles.  Where a piece has more rows than there are cells of two
    features together, these are added up at once and their sums taken apart.
    """
    place = np.full(size, -1, np.int64)
    place[nodes] = np.arange(len(nodes))
    total = None
    for bins, codes, rows, at, weights in views:
        slot = place[at]
        own = np.flatnonzero(slot >= 0)
        slot, rows, weights = slot[own], rows[own].astype(np.int64), [None, *(w[own] for w in weights)]  # numpy gathers fastest by int64
        if total is None:
            total = np.zeros((len(weights), len(bins), len(nodes), cells), np.int64)
        f = 0
        if codes is not None and len(own) >= len(nodes) * cells * cells:
            first, most = slot * (cells * cells), len(nodes) * cells * cells
            for code in codes:
                key = first + code[rows]
                for out, w in zip(total, weights):
                    both = np.bincount(key, w, most).reshape(-1, cells, cells)
                    out[f] += both.sum(axis=2).astype(np.int64)
                    out[f + 1] += both.sum(axis=1).astype(np.int64)
                f += 2
        first, most = slot * cells, len(nodes) * cells
        for f in range(f, len(bins)):
            key = first + bins[f][rows]
            for out, w in zip(total, weights):
                out[f] += np.bincount(key, w, most).reshape(-1, cells).astype(np.int64)
    if total is not None:
        for k, node in enumerate(nodes.tolist()):
            yield node, total[:, :, k]


def _folder(name: str) -> str:
    return os.path.join(SparkFiles.getRootDirectory(), name)


def _put(path: str, array: np.ndarray) -> np.ndarray:
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        np.save(f, array)
    os.replace(own, path)
    return array


def _get(path: str) -> np.ndarray | None:
    try:
        return np.load(path, mmap_mode="r")
    except FileNotFoundError:
        return None
    except ValueError:  # an empty array cannot be mapped
        return np.load(path)


def _keep(part, name: str, cells: int):
    """Write the pieces (piece, labels, bins, *more) of a task beside it; their numbers."""
    at = _folder(name)
    os.makedirs(at, exist_ok=True)
    for piece, labels, bins, *more in part:
        path = os.path.join(at, str(piece))
        for kind, array in zip(("labels", "bins", "codes", *(f"more{k}" for k in range(len(more)))), (labels, bins, paired(bins, cells), *more)):
            _put(f"{path}.{kind}", array)
        yield piece, len(more)


def _forget(path: str, kinds: Iterable[str]) -> None:
    for kind in kinds:
        with contextlib.suppress(FileNotFoundError):
            os.unlink(f"{path}.{kind}")


@dataclass(frozen=True)
class Round:
    """What a job carries: the round, the last trees before it, and ``step`` (piece, round, labels, scores, *more) -> (rows drawn, their weights)."""

    tree: int
    trees: list[Tree]
    step: Callable
    dtype: type


def _scores(path: str, bins: np.ndarray, r: Round) -> np.ndarray:
    for back in range(len(r.trees) + 1):
        t = r.tree - back
        score = _get(f"{path}.score{t}") if t else np.zeros(bins.shape[1], r.dtype)
        if score is not None:
            break
    else:
        raise PieceLost(f"{LOST}: {path}")
    if back:
        every = np.arange(bins.shape[1])
        for t in r.trees[len(r.trees) - back:]:
            score = score + t.value[ends(bins, every, t)]
    if r.tree:
        _put(f"{path}.score{r.tree}", score)
    return score


def views(ids, name: str, r: Round, grown: Tree, depth: int, most: int):
    """(bins, codes, rows, their nodes in ``grown``, weights) of every piece of a task, at level ``depth`` of a round."""
    at_type = np.uint8 if len(grown.feature) <= 256 else np.uint16 if len(grown.feature) <= 1 << 16 else np.int32
    for piece, more in ids:
        path = os.path.join(_folder(name), str(piece))
        bins, codes = _get(f"{path}.bins"), _get(f"{path}.codes")
        if bins is None or codes is None:
            raise PieceLost(f"{LOST}: {path}")
        rows, weights = _get(f"{path}.rows{r.tree}"), _get(f"{path}.weights{r.tree}")
        if rows is None or weights is None:
            own = [_get(f"{path}.{kind}") for kind in ("labels", *(f"more{k}" for k in range(more)))]
            if any(x is None for x in own):
                raise PieceLost(f"{LOST}: {path}")
            rows, weights = r.step(piece, r.tree, own[0], _scores(path, bins, r), *own[1:])
            _put(f"{path}.rows{r.tree}", rows)
            _put(f"{path}.weights{r.tree}", np.stack(weights))
            _forget(path, [f"score{r.tree - 2}", f"rows{r.tree - 1}", f"weights{r.tree - 1}", *(f"at{r.tree - 1}-{d}" for d in range(most + 1))])
        at = _get(f"{path}.at{r.tree}-{depth}") if depth else np.zeros(len(rows), at_type)
        if at is None:
            at = ends(bins, rows, grown, _get(f"{path}.at{r.tree}-{depth - 1}") if depth > 1 else None).astype(at_type)
            _put(f"{path}.at{r.tree}-{depth}", at)
            _forget(path, [f"at{r.tree}-{depth - 1}"])
        yield bins, codes, rows, at, weights


class Pieces:
    """The pieces of ``source``, RDD of (piece, labels, bins, *more), and the trees grown on them so far."""

    def __init__(self, source: RDD, step: Callable, cells: int, depth: int, dtype: type, recent: int, bytes_a_node: int):
        self.source, self.step, self.cells, self.depth, self.dtype, self.recent, self.bytes_a_node = source, step, cells, depth, dtype, recent, bytes_a_node
        self.trees: list[Tree] = []
        self._open()

    def _open(self) -> None:
        self.name, cells = f"pieces-{uuid.uuid4().hex[:12]}", self.cells
        self.ids = self.source.mapPartitions(lambda part, name=self.name: _keep(part, name, cells)).persist(StorageLevel.MEMORY_ONLY)

    def tasks(self) -> int:
        return self.ids.getNumPartitions()

    def sums(self, nodes: np.ndarray, grown: Tree, depth: int, then: Callable):
        """``then`` of an RDD of (node, a task's sums) for ``nodes`` of the tree ``grown`` so far."""
        def job(trees):
            r, name, cells, most = Round(len(self.trees), trees, self.step, self.dtype), self.name, self.cells, self.depth
            return then(self.ids.mapPartitions(lambda part: add_up(views(part, name, r, grown, depth, most), nodes, len(grown.feature), cells)))
        try:
            return job(self.trees[-self.recent:])
        except Exception as e:
            if LOST not in str(e):
                raise
        self.ids.unpersist()
        self._open()
        return job(self.trees[:])

    def level(self, nodes: np.ndarray, count: dict[int, int], above: dict[int, np.ndarray], grown: Tree, depth: int, best: Callable,
              driver_bytes: int) -> tuple[list[tuple], dict[int, np.ndarray]]:
        """(node, ``best`` of it and its sums) for the ``nodes`` of one level, and their sums if the driver has added them.

        Where the driver has the sums of a parent (``above``), the child with fewer rows (``count``) is summed; the other has the rest.
        """
        parent, other = {k: (k - 1) // 2 for k in nodes.tolist()}, {k: k + 1 if k % 2 else k - 1 for k in nodes.tolist()}
        few = np.array(sorted({min(k, other[k], key=count.get) if parent[k] in above else k for k in other}), np.int64)
        if self.tasks() * len(few) * self.bytes_a_node <= driver_bytes:
            total: dict[int, np.ndarray] = {}
            for node, own in self.sums(few, grown, depth, lambda sums: sums.collect()):
                total[node] = total[node] + own if node in total else own
            own = {k: total[k] if k in total else above[parent[k]] - total[other[k]] for k in other if k in total or parent[k] in above}
            return [(k, best(k, sums)) for k, sums in own.items()], own
        tasks = min(len(nodes), self.source.context.defaultParallelism)
        return self.sums(nodes, grown, depth, lambda sums: sums.reduceByKey(np.add, tasks).map(lambda item: (item[0], best(*item))).collect()), {}

    def close(self) -> None:
        """Clear the folders of the executors that hold pieces (Spark clears the others when it ends)."""
        name = self.name
        self.ids.mapPartitions(lambda part: (shutil.rmtree(_folder(name), ignore_errors=True) for _ in (list(part),))).count()
        self.ids.unpersist()
