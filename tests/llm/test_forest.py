"""Operator 9 where leaves are refitted: recall, and work a vector as the table grows."""

import math

import numpy as np
import pytest

from impressa.llm import forest


def links_by_brute_force(x, label, threshold=0.98):
    z = forest.unit(x)
    n = np.zeros(len(x), int)
    for i in range(0, len(x), 500):
        near = (z[i:i + 500] @ z.T >= threshold) & (label[i:i + 500, None] == label[None])
        n[i:i + 500] = near.sum(1) - 1
    return n


@pytest.mark.parametrize("sample,leaf", [(60, 20), (400, 30)])
def test_recall_with_leaves_refitted_in_rounds(spark, monkeypatch, sample, leaf):
    monkeypatch.setattr(forest, "SUBSAMPLE", 150)
    monkeypatch.setattr(forest, "CHUNK", 64)
    rng = np.random.default_rng(7)
    base = rng.standard_normal((1500, 24)) + 0.5
    step = math.sqrt(2 - 2 * 0.985) * np.linalg.norm(base[:500], axis=1, keepdims=True)
    noise = rng.standard_normal((500, 24))
    near = base[:500] + noise / np.linalg.norm(noise, axis=1, keepdims=True) * step  # cosines of about 0.985
    dense = base[1499] + rng.standard_normal((200, 24)) * 0.02
    x = np.concatenate((base, near, dense, np.repeat(base[:1], 50, 0)))
    label = (np.arange(len(x)) % 3 == 0).astype(int)
    d = spark.createDataFrame([(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(x, label))], "vec_id long, embedding array<double>, label int")
    want = links_by_brute_force(x, label)
    got = {r["vec_id"]: r["n_links"] for r in forest.near_duplicates(d, leaf=leaf, sample=sample).collect()}
    n = np.array([got[i] for i in range(len(x))])
    assert (n <= want).all()
    hard = np.arange(1500, 2000)
    assert n.sum() >= 0.97 * want.sum() and n[hard].sum() >= 0.95 * want[hard].sum() > 0


def work(n, dim=32, leaf=150, share=0.25):
    """Copies and comparisons a vector, for one tree fitted on a part of ``n`` random vectors."""
    rng = np.random.default_rng(0)
    x = forest.unit(rng.standard_normal((n, dim)))
    own = x[: max(2000, int(share * n))]
    t = forest.Tree(own, np.zeros(len(own), np.int8), n / len(own), leaf, forest.spill(dim, 0.98), rng, 0)
    sizes = np.array([len(r) for r, _ in t.route(x)])
    return sizes.sum() / n, float((sizes.astype(float) ** 2).sum()) / n


def test_work_a_vector_grows_slowly_with_the_table():
    small, large = work(5_000), work(80_000)
    for a, b in zip(small, large):
        assert 1 + math.log(b / a) / math.log(16) < 1.15  # of the whole, as a power of the number of vectors
