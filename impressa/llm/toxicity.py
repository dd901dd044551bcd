"""Toxicity by non-negative positive-unlabelled learning (operator 1).

Linear classifiers are trained in numpy from confirmed toxic texts (P) and
unlabelled texts (U) alone.  The risk is the class-prior-corrected estimator
``prior * R_P(+1) + max(0, R_U(-1) - prior * R_P(-1))`` with the logistic
loss; when the bracket falls below zero the step goes against it, which keeps
a flexible model from driving the estimated negative risk under zero.  Known
clean labels are used for one number only, the class prior (the toxic share of
the labelled rows), when it is not given.

Features of a text: which of its words and their 4- and 5-grams occur
(boundary marked, words lower-cased).  Of those that are more frequent
in P than in U the ``features`` best by log-likelihood ratio are kept, if
their ratio exceeds ``evidence``.  ``models`` classifiers are trained
on different draws of U and their probabilities averaged.

Scale: the fit uses a bounded sample (``max_positive`` and ``max_unlabelled``
rows of smallest id hash; ids and kept features, not texts, reach the driver), and the
model (``features`` weights per classifier) is what is broadcast.  Scoring is
one narrow pass over whole texts.

Defined results: null or empty text has no feature and gets the intercept's
score; rows with null ids are scored, never learned from; repeated rows are
scored alike; a null label is no label; an id labelled both ways counts as
toxic; without positives or unlabelled rows every score is 0; an empty table
gives no rows; other columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impressa.llm.common import text_bytes

TOKEN = re.compile(r"\w+")


@dataclass(frozen=True)
class Settings:
    """Bounds of the fit sample, and the learner's parameters."""

    max_positive: int = 4000
    max_unlabelled: int = 8000
    features: int = 4096
    evidence: float = 16.0
    models: int = 3
    epochs: int = 60
    batches: int = 8
    step: float = 0.05
    decay: float = 1e-4
    seed: int = 11


def grams(word: str) -> list[str]:
    """The word and its 4- and 5-grams, with boundary marks."""
    w = f"<{word}>"
    return [w, *(w[i:i + n] for n in (4, 5) for i in range(len(w) - n + 1))]


class Extractor:
    """Distinct kept features of a text, by word, with a bounded memo of words."""

    def __init__(self, keep: list[str], memo: int = 200_000):
        self.number = {g: i for i, g in enumerate(keep)}
        self.memo, self.seen = memo, {}

    def word(self, w: str) -> tuple[int, ...]:
        number = self.number
        f = self.seen[w] = tuple({number[g] for g in grams(w) if g in number})
        return f

    def text(self, text: bytes) -> np.ndarray:
        if len(self.seen) > self.memo:
            self.seen.clear()
        seen, found = self.seen, set()
        for w in set(TOKEN.findall(text.decode("utf-8", "replace").lower())):
            f = seen.get(w)
            if f is None:
                f = self.word(w)
            if f:
                found.update(f)
        return np.array(sorted(found), np.int32)


def feature_counts(sample: DataFrame) -> DataFrame:
    """(f, p, u): in how many sampled texts of P and of U each feature occurs."""

    def run(batches):
        sums: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for x, *sides in zip(*(b.column(c).to_pylist() for c in ("text", "p", "u"))):
                f = {g for w in set(TOKEN.findall(x.decode("utf-8", "replace").lower())) for g in grams(w)}
                for own, on in zip(sums, sides):
                    if on:
                        own.update(f)
                if len(sums[1]) + len(sums[0]) > 600_000:
                    yield flush(sums)
        yield flush(sums)

    def flush(sums):
        f = list(sums[0].keys() | sums[1].keys())
        n = [pa.array([own[g] for g in f], pa.int64()) for own in sums]
        for own in sums:
            own.clear()
        return pa.RecordBatch.from_arrays([pa.array(f, pa.string()), *n], ["f", "p", "u"])

    return sample.mapInArrow(run, "f string, p long, u long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))


def select_features(sample: DataFrame, n_pos: int, n_unl: int, s: Settings) -> list[str]:
    """Features more frequent in P than in U, by log-likelihood ratio: the best that exceed ``evidence``."""
    p, u = F.col("p"), F.col("u")
    both = (p + u) / F.lit(float(n_pos + n_unl))

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    g2 = 2 * (part(p, n_pos * both) + part(u, n_unl * both)
              + part(n_pos - p, n_pos * (1 - both)) + part(n_unl - u, n_unl * (1 - both)))
    best = (feature_counts(sample).where(p / F.lit(float(n_pos)) > u / F.lit(float(n_unl))).withColumn("g2", g2)
            .where(F.col("g2") >= s.evidence).orderBy(F.desc("g2"), "f").limit(s.features).select("f").collect())
    return sorted(r[0] for r in best)


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    return at, np.concatenate(rows) if len(at) else np.empty(0, np.int64)


def fit_nnpu(pos: list[np.ndarray], unl: list[np.ndarray], dim: int, prior: float, s: Settings, seed: int) -> tuple[np.ndarray, float]:
    """Weights and intercept by Adam on the non-negative risk, in mini-batches of P and U."""
    rng = np.random.default_rng(seed)
    w = np.zeros(dim + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v, t = np.zeros(dim + 1), np.zeros(dim + 1), 0

    def part(rows):
        at, f = _flat(rows)
        return at, f, len(rows)

    def margin(x):
        return np.bincount(x[0], w[x[1]], x[2]) + w[-1]

    def grad(x, per_row):
        g = np.bincount(x[1], per_row[x[0]], dim + 1)
        g[-1] = per_row.sum()
        return g / x[2]

    for _ in range(s.epochs):
        pp, uu = rng.permutation(len(pos)), rng.permutation(len(unl))
        k = max(1, min(s.batches, len(pos), len(unl)))
        for a, b in zip(np.array_split(pp, k), np.array_split(uu, k)):
            xp, xu = part([pos[i] for i in a]), part([unl[i] for i in b])
            zp, zu = margin(xp), margin(xu)
            sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            g_neg = grad(xu, su) - prior * grad(xp, sp)
            g = prior * grad(xp, sp - 1) + g_neg if negative >= 0 else -g_neg
            g[:-1] += s.decay * w[:-1]
            t += 1
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g * g
            w -= s.step * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w[:-1], w[-1]


@dataclass(frozen=True)
class Model:
    keep: list[str]
    weights: np.ndarray
    intercepts: np.ndarray

    def scorer(self):
        ex = Extractor(self.keep)

        def score(text: bytes) -> float:
            z = self.weights[:, ex.text(text)].sum(1) + self.intercepts
            return float(np.mean(1 / (1 + np.exp(-z))))

        return score


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, settings: Settings = Settings(), prior: float | None = None) -> Model | None:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); rows failing ``learn_from`` take no part."""
    spark, s = docs.sparkSession, settings
    ok = F.lit(True) if learn_from is None else learn_from
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).where(ok)
             .groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("y")))
    if prior is None:
        got = known.agg(F.avg("y")).first()[0]
        prior = min(0.9, max(0.001, got or 0.0))
    order = F.xxhash64("doc_id", F.lit(s.seed))
    toxic = known.where("y = 1").select("doc_id")
    ids = docs.where(F.col("doc_id").isNotNull()).where(ok).select("doc_id")
    def least(df, n):
        return [r[0] for r in df.orderBy(order, "doc_id").limit(n).collect()]

    pos_ids = least(toxic.join(ids, "doc_id", "left_semi"), s.max_positive)
    unl_ids = least(ids.distinct(), s.max_unlabelled)
    pos_set = set(pos_ids)
    chosen = sorted(pos_set | set(unl_ids))
    if not pos_ids or not unl_ids:
        return None
    unl_set = set(unl_ids)
    pick = spark.createDataFrame([(i, i in pos_set, i in unl_set) for i in chosen], "doc_id long, p boolean, u boolean")
    sample = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).join(F.broadcast(pick), "doc_id")
    keep = select_features(sample, len(pos_ids), len(unl_ids), s)

    def extract(batches):
        ex = Extractor(keep)
        for b in batches:
            data = [ex.text(x).tobytes() for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "f"])

    rows: dict[int, bytes] = {}
    for r in sample.select("doc_id", "text").mapInArrow(extract, "doc_id long, f binary").toLocalIterator():
        have = bytes(r["f"])
        rows[r["doc_id"]] = min(have, rows.get(r["doc_id"], have))
    feats = {i: np.frombuffer(f, np.int32) for i, f in rows.items()}
    pos, unl = [feats[i] for i in pos_ids], [feats[i] for i in unl_ids]
    fits = []
    for k in range(s.models):
        own = unl if s.models == 1 else [u for i, u in enumerate(unl) if i % s.models != k] or unl
        fits.append(fit_nnpu(pos, own, len(keep), prior, s, s.seed + k))
    return Model(keep, np.array([w for w, _ in fits]), np.array([b for _, b in fits]))


def score(docs: DataFrame, model: Model | None, name: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with a column ``name``: the probability that the whole text is toxic."""
    if model is None:
        return docs.withColumn(name, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxic(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = None
        for p in parts:
            one = one or shared.value.scorer()
            yield pd.Series([one(x) for x in p], dtype=float)

    return docs.withColumn(name, toxic(text_bytes(text)))


def reject(docs: DataFrame, labels: DataFrame, at: float = 0.5, **kw) -> DataFrame:
    """``docs`` without the rows whose score is ``at`` or more; same columns."""
    mark = "__llm_score"
    return score(docs, fit(docs, labels, **kw), mark).where(F.col(mark) < at).select(*docs.columns)
