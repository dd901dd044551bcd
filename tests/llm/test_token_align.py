"""Operator 11 against brute force: whole table, odd texts, small runs and merges by levels."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from impressa.llm import catalog, token_align
from impressa.llm.common import table
from impressa.llm.token_count import byte_of_symbol

NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def files():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as g:
        return f.read(), g.read(), public_tokenizers.PATTERN


def ends(pieces):
    return np.cumsum([len(p) for p in pieces]).tolist()


def brute(texts):
    """Result columns of every text, from the libraries' ids and plain counting."""
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte = byte_of_symbol()
    out, links = [], []
    for t in texts:
        own = Counter()
        if t:
            e = lib.encode(" " + t, add_special_tokens=False)
            a, b = e.ids, sp.encode(t)
            wa = [bytes(byte[c] for c in lib.id_to_token(i)) for i in a]
            wb = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(wa) == b"".join(wb) == (" " + t).encode():
                common = sorted(set(ends(wa)) & set(ends(wb)))
                groups, i, j = [], 0, 0
                ea, eb = ends(wa), ends(wb)
                for c in common:
                    i2, j2 = ea.index(c, i) + 1, eb.index(c, j) + 1
                    groups.append((a[i:i2], b[j:j2]))
                    own.update((x, y) for x in a[i:i2] for y in b[j:j2])
                    i, j = i2, j2
                said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
                out.append([len(a), len(b), len(groups), sum(own.values()), 0, 0, hashlib.sha256(said.encode()).hexdigest()])
                links.append(own)
                continue
        out.append([0, 0, 0, 0, 0, 0, ""])
        links.append(own)
    count = Counter(p for own in links for p in own)
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    for row, own in zip(out, links):
        row[4] = sum(m for p, m in own.items() if count[p] == top[p[0]])
        row[5] = sum(m * count[p] for p, m in own.items())
    return [tuple(r) for r in out]


def rows(df):
    return sorted((str(r["doc_id"]), *(r[c] for c in NAMES)) for r in df.collect())


def expected(ids, texts):
    return sorted((str(i), *r) for i, r in zip(ids, brute(texts)))


def test_whole_table(spark, sf):
    docs = table(spark, sf, "documents").collect()
    assert rows(catalog.op11_token_align(spark, sf)) == expected([r["doc_id"] for r in docs], [r["text"] for r in docs])


def test_odd_texts(spark, odd_docs, files):
    docs = odd_docs.collect()
    assert rows(token_align.align(odd_docs, *files)) == expected([r["doc_id"] for r in docs], [r["text"] for r in docs])
    assert token_align.align(odd_docs.limit(0), *files).count() == 0
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert rows(token_align.align(none, *files)) == expected([1, 2], [None, ""])


@pytest.mark.parametrize("records,fan_in,radixes", [(50, 2, 3), (400, 3, 1), (1, 5, 7)])
def test_small_runs_merge_by_levels(spark, files, records, fan_in, radixes, monkeypatch):
    rng = random.Random(records)
    words = ["the", "tokens", "Zähler", "日本語", "a▁b", "<s>", "<|endoftext|>", "  ", "\n", "naïve", "😀", "x" * 30, "'s", "\x00", "½"]
    texts = ["".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randint(0, 25))) for _ in range(120)] + [None, "", " ", "same same"] * 4
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = token_align.align(df, *files, radixes=radixes, records=records, fan_in=fan_in)
    assert rows(got) == expected(range(len(texts)), texts)


def test_large_groups_and_long_blanks(spark, files):
    texts = ["a" * 3000, " " * 60_000 + "x", "ab" * 2000, "é" * 700, "\t\n" * 500, "aaab" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    old = token_align.LARGE_GROUP
    try:
        for token_align.LARGE_GROUP in (1, old):
            assert rows(token_align.align(df, *files)) == expected(range(len(texts)), texts)
    finally:
        token_align.LARGE_GROUP = old


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_merge_sums_and_maxima(block, monkeypatch):
    rng = np.random.default_rng(block)
    monkeypatch.setattr(token_align, "BLOCK", block)
    slices = []
    for _ in range(9):
        p = np.unique(rng.integers(0, 400, rng.integers(1, 200)))
        slices.append((p, rng.integers(1, 5, len(p))))
    want = Counter()
    for p, c in slices:
        want.update(dict(zip(p.tolist(), c.tolist())))
    got = [x for p, c in token_align.merged(slices) for x in zip(p.tolist(), c.tolist())]
    assert got == sorted(want.items())
    top = {}
    for p, c in want.items():
        top[p // 10] = max(top.get(p // 10, 0), c)
    for (p, _), t in zip(slices, token_align.totals(slices, 10)):
        assert t.tolist() == [2 * want[x] + (want[x] == top[x // 10]) for x in p.tolist()]
