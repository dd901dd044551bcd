"""Operator 5: the filter's error rate, both ways of reading it, and scores against exact levels."""

import math
from collections import Counter

import numpy as np

from impressa.llm import catalog, lm
from impressa.llm.common import crc_bucket, py_crc_bucket, table, text_bytes


def hashed(spark, sf):
    return table(spark, sf, "documents").select("doc_id", (crc_bucket("doc_id", 10) == 0).alias("held_out"), text_bytes().alias("text"))


def test_false_positive_rate_does_not_depend_on_the_number_of_entries():
    rng = np.random.default_rng(1)
    for n in (2_000, 300_000):
        h = np.unique(rng.integers(0, 2 ** 63, n, dtype=np.uint64))
        m = lm.Model.of_segments({0: lm.build_segment(h, rng.geometric(0.5, len(h)))}, 1)
        other = m.count_levels(rng.integers(2 ** 63, 2 ** 64 - 1, 100_000, dtype=np.uint64))
        assert (other > 0).mean() < 0.02


def test_runs_of_counts_survive_the_way_to_a_segment():
    rng = np.random.default_rng(2)
    for n in (0, 1, 1000):
        h = np.unique(rng.integers(0, 2 ** 64 - 1, n, dtype=np.uint64))
        c = rng.choice([1, 2, 254, 255, 256, 10 ** 6], len(h))
        a, b = lm.received(lm.sent(h, c))
        assert (a == h).all() and (b == c).all()


def test_broadcast_and_segments_give_the_same_scores(spark, sf, monkeypatch):
    monkeypatch.setattr(lm, "PIECE_BYTES", 200_000)
    monkeypatch.setattr(lm, "HELD", 20_000)
    d = hashed(spark, sf)
    fitted = lm.fit(d)
    assert 0 < fitted.filter_bytes < lm.BROADCAST_BYTES
    whole, parts = ({r["doc_id"]: tuple(r) for r in lm.score(d, fitted, ["doc_id"], limit).collect()} for limit in (None, 0))
    assert len(whole) == d.count() and set(whole) == set(parts)
    for i, r in whole.items():
        assert r[:3] == parts[i][:3] and all(abs(x - y) < 1e-9 * max(1, abs(x)) for x, y in zip(r[3:], parts[i][3:]))


def test_scores_are_near_those_of_exact_levels(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, sf, "documents").collect()}
    texts = {i: [b"\n", *lm.words(t.encode()), b"\n"] for i, t in docs.items()}
    train = [t for i, t in texts.items() if py_crc_bucket(i, 10)]
    uni, bi = Counter(w for t in train for w in t[1:]), Counter(p for t in train for p in zip(t, t[1:]))
    whole = sum(uni.values()) + 0.1 * (len(uni) + 1)
    read = [0.0, *lm.middle(lm.level(np.arange(1, max(uni.values()) + 1))).tolist()]
    apart, tokens = 0.0, 0
    for r in catalog.op5_lm_score(spark, sf).collect():
        t = texts[r["doc_id"]]
        want = sum(math.log10((min(read[bi[a, b]], read[uni[a]]) + 2 * (read[uni[b]] + 0.1) / whole) / (read[uni[a]] + 2)) for a, b in zip(t, t[1:]))
        apart += abs(r["score"] - want)
        tokens += len(t) - 1
    assert apart / tokens < 0.03  # log10 units a token, from false positives alone
