"""The pipeline's stages against brute force, each on its own input."""

import re

import corpus_pipeline
from impressa.llm import line_dedup, toxicity
from impressa.llm.common import table

from test_ops import brute_fp, shingle_counts, tokens, union_find


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    named = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "mix_to_weights"]

    def after(name, d):
        out = corpus_pipeline.stage(named[name](spark, d, sf), "test-" + name)
        if name != "mix_to_weights":
            assert out.columns == columns
        return out

    a = after("toxicity", docs)
    model = toxicity.fit(docs, table(spark, sf, "labels").select("doc_id", "toxic"))
    bad = {r["doc_id"] for r in toxicity.score(docs, model).where("score >= 0.5").collect()}
    assert bad and {r["doc_id"] for r in a.collect()} == {r["doc_id"] for r in docs.collect()} - bad

    b = after("line_dedup", a)
    rows = {r["doc_id"]: r["text"] for r in a.collect()}
    sites, first = {}, {}
    for r in a.collect():
        for x in set(r["text"].split("\n")):
            if len(tokens(x)) >= line_dedup.MIN_WORDS:
                sites.setdefault(x.strip(" "), set()).add(r["source"])
                first[x.strip(" ")] = min(r["doc_id"], first.get(x.strip(" "), r["doc_id"]))
    want = {}
    for i, text in rows.items():
        kept = [x for x in text.split("\n") if len(sites.get(x.strip(" "), ())) < line_dedup.MIN_SITES or first[x.strip(" ")] == i]
        new = "\n".join(kept)
        if new.strip(" ") or new == text:
            want[i] = new
    assert {r["doc_id"]: r["text"] for r in b.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in b.collect() if r["text"] != rows[r["doc_id"]])

    c = after("simhash_near_dedup", b)
    fp = {i: brute_fp(t) for i, t in want.items()}
    ids = sorted(fp)
    comp = union_find([(x, y) for n, x in enumerate(ids) for y in ids[n + 1:] if (fp[x] ^ fp[y]).bit_count() <= 4], ids)
    assert {r["doc_id"] for r in c.collect()} == set(comp.values())

    d = after("benchmark_decontamination", c)
    items = [tokens(r["text"]) for r in table(spark, sf, "benchmark").collect()]
    known = {g for w in items for g in shingle_counts(w)}
    left = set()
    for r in c.collect():
        w = tokens(r["text"])
        leak = False
        if known & shingle_counts(w).keys():
            for iw in items:
                n, ic = min(len(iw), len(w)), shingle_counts(iw)
                for s in range(len(w) - n + 1):
                    x = shingle_counts(w[s:s + n])
                    both = sum((x & ic).values())
                    leak = leak or both >= 0.8 * (sum(x.values()) + sum(ic.values()) - both)
        if not leak:
            left.add(r["doc_id"])
    assert {r["doc_id"] for r in d.collect()} == left and len(left) < c.count()

    e = after("mix_to_weights", d)
    assert all(r["taken"] in (r["size"], 2 * r["size"]) and r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in e.collect())


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and "taken" in got.columns
