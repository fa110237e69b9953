"""The pipeline on the smallest tables against a plain restatement of its exact stages."""

import hashlib

import pytest


@pytest.fixture(scope="module")
def stages(spark, sf):
    import corpus_pipeline

    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        after = f(spark, docs, sf).cache()
        out.append((name, docs, after))
        docs = after
    return out


def test_stages(stages):
    from test_operators import brute_components

    names = [n for n, _, _ in stages]
    assert names == ["quality classifier", "exact dedup", "MinHash near-dedup", "benchmark decontamination", "BPE encoding and decoding"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and after.count() <= before.count()
    rows = [[(r.doc_id, r.text) for r in d.collect()] for _, d, _ in stages] + [[(r.doc_id, None) for r in stages[-1][2].collect()]]
    last = {}
    for i, t in rows[1]:
        last[t] = max(i, last.get(t, -1))
    assert sorted(i for i, _ in rows[2]) == sorted(last.values())
    assert sorted(i for i, _ in rows[3]) == sorted({c for _, c in brute_components(rows[2], 5, 80).values()})
    assert sorted(i for i, _ in rows[4]) == sorted(i for i, _ in rows[5])
    text = dict(rows[4])
    assert all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in stages[-1][2].collect())


def test_labelled_rows(stages, spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[0][2].select("doc_id").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) > 0.97 * len(good)


def test_first_and_fourth_stage_against_the_operators(stages, spark, sf):
    """The quality stage keeps what its model scores 0.3 or more, and decontamination drops what holds an item, by plain restatements."""
    import re

    import numpy as np

    from corpusguard.llm import quality
    from corpusguard.llm.textkit import pieces
    import pyarrow as pa

    docs = {r.doc_id: r.text or "" for r in stages[0][1].collect()}
    model = quality.train(stages[0][1], spark.read.parquet(f"{sf}/labels.parquet"))
    keys, kept = list(docs), set()
    for first, _, buffer, starts in pieces(pa.array([docs[k] for k in keys])):
        for k, row in enumerate(quality.features(buffer, starts), first):
            y = (row * model.idf) @ model.basis
            near = np.maximum(model.vectors.T @ (y / max(float(np.linalg.norm(y)), 1e-12)), 0).astype(float)
            best = np.argsort(-near, kind="stable")[: quality.NEIGHBOURS]
            weight = near[best] ** quality.SHARPNESS
            score = (weight * model.labels[best]).sum() / weight.sum() if weight.sum() else model.prior
            if abs(score - quality.ACCEPT) < 1e-4:
                kept.add(None)
            elif score > quality.ACCEPT:
                kept.add(keys[k])
    assert None not in kept and {r.doc_id for r in stages[0][2].select("doc_id").collect()} == kept
    tokens = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    items = [tokens(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before, after = ({r.doc_id: r.text or "" for r in d.collect()} for d in stages[3][1:])
    for i, text in before.items():
        own = grams(tokens(text))
        share = max(sum(g in own for g in grams(w)) / max(1, len(grams(w))) for w in items)
        # what holds nearly all of an item goes; what holds less than the overlap stays
        assert (i in after) if share < 0.8 else (i not in after or share < 0.95), (i, share)
