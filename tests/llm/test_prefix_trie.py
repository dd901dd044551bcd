"""Operator 13 against brute force: random tries, hot groups, odd rows, and the skeleton's integers."""

import binascii
import hashlib
import random
from collections import defaultdict

import pytest

from impressa.llm import catalog, prefix_trie
from impressa.llm.common import table

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """(conv_id, turn, role, text) rows -> set of result tuples."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = binascii.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        paths[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    out = set()
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if paths[c] == p))
        out.add((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids[p]), leaves[p], saved[p],
                 hashlib.sha256(ends.encode()).hexdigest()))
    return out


def result(df):
    rows = [tuple(r[c] for c in prefix_trie.RESULT) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed,shards", [(0, 1), (1, 2), (2, 7), (3, 40), (4, 300)])
def test_random_tries(spark, seed, shards):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-150, 900), 250):
        depth = rng.choice([1, 2, 3, 8, 8, 20])
        hot = rng.random() < 0.3
        for t in range(depth):
            rows.append((c, t, rng.choice(["user", "assistant"]) if not hot else "user", "same" if hot else rng.choice("abc") * (t % 3)))
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(prefix_trie.trie(prefix_trie.rebuilt(df), shards)) == brute(rows)


def test_whole_table(spark, sf):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table(spark, sf, "conversations").collect()]
    assert result(catalog.op13_prefix_trie(spark, sf)) == brute(rows)


def test_copies_over_many_shards_and_id_lists(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS_A_ROW", 3)
    rows = [(100 * c, t, "user", f"turn {t}") for c in range(300) for t in range(6)]
    rows += [(100 * c + 7, t, "user", "é" * t) for c in range(20) for t in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(prefix_trie.trie(prefix_trie.rebuilt(df), 60)) == brute(rows)


def test_odd_rows_and_empty_tables(spark):
    rows = [(None, 0, "user", "x"), (1, None, "user", "first"), (1, 0, None, None), (1, 0, None, None), (0, 3, "user", ""), (0, 3, "", "user"),
            (2, 0, "user", "x" * 500_000), (2, 0, "user", "x" * 500_000), (-5, 1, "user", "neg"), (305, 1, "user", "lonely"),
            (4, 0, "\x00", "\x00"), (4, 1, "a", "b:c"), (6, 1, "ab", ":c")]
    wide = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA + ", depth int, path string")
    assert result(prefix_trie.query(wide)) == brute(rows)
    none = spark.createDataFrame([], SCHEMA)
    assert result(prefix_trie.query(none)) == set()
    assert result(prefix_trie.query(spark.createDataFrame(rows[:1], SCHEMA))) == set()


def test_skeleton_owners_against_direct_scan():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(1, 12)
        inside, across = [rng.randint(0, 5) for _ in range(n + 1)], [rng.randint(0, 5) for _ in range(n)]
        sk = prefix_trie.Skeleton(inside, across)

        def owner(b, d):
            while b and min(across[b - 1], inside[b]) >= d:
                b -= 1
            return b

        for s, (left, right) in sk.owners(set(range(n + 1))).items():
            assert left == ([owner(s - 1, d) for d in range(across[s - 1] + 1)] if s else [])
            assert right == ([owner(s, d) for d in range(across[s] + 1)] if s < n else [])
