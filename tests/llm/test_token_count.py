"""Operator 12 against the library itself: whole table, random strings, long pretokens, cut points."""

import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from impressa.llm import catalog, token_count
from impressa.llm.common import table

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", "'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "1", "23", "!", "?", "é", "ß", "日本", "😀", "'LL", "the", " the",
         "ing", "\r\n", "\u0085", " ", "½", "\x00", "<|endoftext|>", "<|endof", "text|>"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    with open(PATH, encoding="utf-8") as f:
        return token_count.compiled(f.read())


def counts(counter, texts):
    raw = [t.encode() for t in texts]
    return counter.count(b"".join(raw), np.cumsum([0, *map(len, raw)])).tolist()


def library_counts(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_whole_table(spark, sf, library):
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, sf, "documents").collect()}
    got = catalog.op12_token_count(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    want = dict(zip(docs, library_counts(library, list(docs.values()))))
    for r in got:
        assert (r["n_bytes"], r["n_tokens"]) == (len(docs[r["doc_id"]].encode()), want[r["doc_id"]])
        assert r["over_limit"] == (r["n_tokens"] > 1024)


def test_random_texts_and_document_borders(counter, library):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    texts += ["".join(chr(rng.choice([rng.randint(0, 0x2ff), rng.randint(0, 0xd7ff), rng.randint(0xe000, 0x10ffff)])) for _ in range(20))
              for _ in range(100)]
    assert counts(counter, texts) == library_counts(library, texts)
    assert counts(counter, []) == [] and counts(counter, ["", ""]) == [0, 0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab'stremvld \n1!é"), max_size=30), max_size=5))
def test_any_texts(counter, texts):
    library = Tokenizer.from_file(PATH)
    assert counts(counter, texts) == library_counts(library, texts)


@pytest.mark.parametrize("chunk", [1, 2, 7, 64])
def test_chunk_maps_compose_whatever_the_cut(counter, library, monkeypatch, chunk):
    monkeypatch.setattr(token_count, "CHUNK", chunk)
    rng = random.Random(chunk)
    texts = ["".join(rng.choice("abcde") for _ in range(3000)), " " * 700, "the quick brown fox's tail, isn't it? " * 20, "", "a", "é" * 500,
             "\n" * 300 + "x", "aaab" * 400]
    assert counts(counter, texts) == library_counts(library, texts)


def test_long_pretokens(counter, library):
    texts = ["a" * 1_000_000, " " * 300_000 + "x", "ab" * 200_000, "'" * 50_000]
    assert counts(counter, texts) == library_counts(library, texts)


def test_states_are_dropped_at_the_bound(library, monkeypatch):
    with open(PATH, encoding="utf-8") as f:
        own = token_count.Counter(f.read())
    monkeypatch.setattr(token_count, "MAX_STATES", 50)
    for texts in (["words of one kind"], ["other words entirely"], ["words of one kind"]):
        assert counts(own, texts) == library_counts(library, texts)


def test_odd_rows(spark, odd_docs, library):
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_count.query(odd_docs).collect()), key=str)
    rows = odd_docs.collect()
    n = library_counts(library, [r["text"] or "" for r in rows])
    assert got == sorted(((r["doc_id"], len((r["text"] or "").encode()), k, k > 1024) for r, k in zip(rows, n)), key=str)
    assert token_count.query(odd_docs.limit(0)).count() == 0


def test_other_tokenizers_raise():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f, pytest.raises(ValueError):
        token_count.Counter(f.read())
