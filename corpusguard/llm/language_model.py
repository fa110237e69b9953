"""Language-model scores: bigram, unigram and uniform estimates mixed by deleted interpolation."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Blocks, arrow_schema, by_range, equal_runs, pack, pack_sorted, unpack, unpack_sorted
from .textkit import hashed_words, mix
from .workspace import staged

#: Fold of the training documents whose counts the mixture weights are learned on.
TUNING_FOLD = 3
#: Buckets of context frequency: 0, 1, 2-3, 4-7, ...
BUCKETS = 24
#: Steps to a factor of e of the estimates in the table that expectation-maximisation runs on, and its extent.
GRID, DEPTH = 8, 200
ROUNDS = 100
START, END = np.uint64(0x1234567890ABCDEF), np.uint64(0x0FEDCBA987654321)


def _tokens(starts: np.ndarray, buffer: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and document of each token (the end of each document included), hash of the token before it, and of the pair."""
    n = len(starts)
    words, docs = hashed_words(buffer, starts)
    count = np.bincount(docs, minlength=n)
    token = np.full(len(words) + n, END)
    own = np.repeat(np.arange(n), count + 1)
    token[np.arange(len(words)) + docs] = words
    before = np.concatenate([[START], token[:-1]])
    before[(np.cumsum(count + 1) - count - 1)] = START
    return token, own, before, mix(before * np.uint64(0x9E3779B97F4A7C15) + token)


def _fold(doc_id: int | None, parts: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % parts


def _sum_range(rows: pa.Table) -> pa.Table:
    """Totals of one range's runs: a reply for each run, and a row (block -1) with the distinct keys that training has, and their sum."""
    blocks, kind, range_ = rows.column("block").to_pylist(), rows.column("kind")[0].as_py(), rows.column("range")[0].as_py()
    keys = [unpack_sorted(x.as_py()) for x in rows.column("keys")]
    ends = np.cumsum([len(k) for k in keys])
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    main, tuning = (np.bincount(at, np.concatenate([unpack(x.as_py(), "<u4") for x in rows.column(c)]), len(every)).astype(np.uint64) for c in ("main", "tuning"))
    out = [{"block": b, "kind": kind, "range": range_, "main": pack(main[at[e - len(k) : e]]), "tuning": pack(tuning[at[e - len(k) : e]]), "n": 0, "total": 0, "main_total": 0} for b, k, e in zip(blocks, keys, ends.tolist(), strict=True)]
    out.append({"block": -1, "kind": kind, "range": range_, "main": None, "tuning": None, "n": int(((main + tuning) > 0).sum()), "total": int((main + tuning).sum()), "main_total": int(main.sum())})
    return pa.Table.from_pylist(out, schema=arrow_schema(_REPLY))


_REPLY = "block bigint, kind int, range int, main binary, tuning binary, n bigint, total bigint, main_total bigint"


def _answers(token: np.ndarray, pair: np.ndarray, before: np.ndarray, replies: pa.Table, n_docs: tuple[int, int]) -> tuple[np.ndarray, ...]:
    """(main, tuning) counts of each token, pair and context."""
    found = {}
    parts = {}
    for kind, range_, main, tuning in zip(*(replies.column(c).to_pylist() for c in ("kind", "range", "main", "tuning")), strict=True):
        parts[kind, range_] = unpack(main, "<u8"), unpack(tuning, "<u8")
    for kind, values in ((0, token), (1, pair)):
        mine = [parts[k] for k in sorted(parts) if k[0] == kind]
        keys, at = np.unique(values, return_inverse=True)
        found[kind] = keys, at, np.concatenate([m for m, _ in mine]), np.concatenate([t for _, t in mine])
    keys, at, main, tuning = found[0]
    place = np.minimum(np.searchsorted(keys, before), len(keys) - 1)
    first = before == START
    context = np.where(first, n_docs[0], main[place]).astype(np.float64), np.where(first, n_docs[1], tuning[place]).astype(np.float64)
    _, pair_at, pair_main, pair_tuning = found[1]
    return main[at].astype(np.float64), tuning[at].astype(np.float64), pair_main[pair_at].astype(np.float64), pair_tuning[pair_at].astype(np.float64), *context


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(np.maximum(context, 0) + 0.5)).astype(np.int64) + 1, BUCKETS - 1).clip(0)


def learn_weights(cells: list[tuple[int, int, float, float, float]], uniform: float, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights (bigram, unigram, uniform) by context bucket: expectation-maximisation on a table of (bucket, cell, count, pair, one).

    A cell stands for a pair of estimates: the geometric means of those that fell into it, whose negative logarithms add
    up to `pair` and `one`. Buckets without counts take the weights of all counts. The pair's estimate
    has no weight in bucket 0, whose contexts were never seen, so that the estimates of a context always add up to 1.
    """
    weights = np.full((BUCKETS, 3), 1 / 3)
    unseen = np.array([0, 0.5, 0.5])
    weights[0] = unseen
    if not cells:
        return weights
    bucket, cell, count, pair, one = (np.array(x) for x in zip(*cells, strict=True))
    up, low = cell // (DEPTH + 1), cell % (DEPTH + 1)
    p = np.stack([np.where(up < DEPTH, np.exp(-pair / count), 0), np.where(low < DEPTH, np.exp(-one / count), 0), np.full(len(cell), uniform)], axis=1)
    groups = [(b, bucket == b) for b in range(BUCKETS)] + [(-1, np.ones(len(cell), bool))]
    shared = None
    for b, own in reversed(groups):
        if not own.any():
            weights[b] = shared if b else shared * (unseen > 0) / max(shared[1:].sum(), 1e-300)
            continue
        w = np.full(3, 1 / 3) if b else unseen
        for _ in range(rounds):
            part = p[own] * w
            w = (part / part.sum(axis=1, keepdims=True) * count[own][:, None]).sum(axis=0)
            w /= w.sum()
        if b < 0:
            shared = w
        else:
            weights[b] = w
    return weights


def score_texts(docs: DataFrame, held_out: tuple[int, int] = (7, 2), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs.

    Tokens: runs of bytes outside 0x20 and 0x09-0x0D, A-Z lower-cased, then one end for each document. base_score: the
    log10 probability by unigram counts plus one; score: that of the interpolated model. Counts are of all documents
    outside the held-out fold; tokens and pairs are told apart by 64-bit hashes. The model's estimates are maximum-likelihood ones of pairs, of tokens, and 1 / (V + 1),
    mixed by weights that depend on how often the context was seen; the weights are learned by expectation-maximisation
    on the counts of the documents of one training fold, with estimates from the others. A null or empty text has its
    end alone; a null id is in the fold of an empty one; equal rows are counted and scored each; without training rows
    every estimate but the uniform one is 0; no rows give no rows.
    """
    parts, out_fold = held_out
    blocks = Blocks(docs, key, text)
    ranges = blocks.ranges

    def runs(ids: list, starts: np.ndarray, buffer: bytes) -> Iterator[tuple]:
        token, own, _, pair = _tokens(starts, buffer)
        folds = np.array([_fold(i, parts) for i in ids])
        tuning = folds == TUNING_FOLD
        main = (folds != out_fold) & ~tuning
        for kind, values in ((0, token), (1, pair)):
            keys, at = np.unique(values, return_inverse=True)
            counts = [np.bincount(at, w[own], len(keys)).astype("<u4") for w in (main, tuning)]
            for r, s in equal_runs(by_range(keys, ranges)):
                yield kind, r, pack_sorted(keys[s]), pack(counts[0][s]), pack(counts[1][s])

    sent = blocks.send(runs, "kind int, range int, keys binary, main binary, tuning binary")
    replies = staged(sent.groupBy("kind", "range").applyInArrow(_sum_range, _REPLY), "counts")
    sums = replies.filter("block = -1 and kind = 0").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "total", "main_total")]).first()
    distinct, train_tokens, main_tokens = sums["n"], sums["total"], sums["main_total"]
    folds = docs.select(F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(parts)).alias("f")).groupBy("f").count().collect()
    n_docs = sum(r["count"] for r in folds if r["f"] not in (out_fold, TUNING_FOLD)), sum(r["count"] for r in folds if r["f"] == TUNING_FOLD)
    own_replies = replies.filter("block >= 0").select("block", "kind", "range", "main", "tuning")
    uniform = 1.0 / (distinct + 1)

    def tally(ids: list, starts: np.ndarray, buffer: bytes, got: pa.Table) -> list[tuple]:
        token, own, before, pair = _tokens(starts, buffer)
        held = np.array([_fold(i, parts) == TUNING_FOLD for i in ids])[own]
        if not held.any():
            return []
        one, _, two, _, context, _ = (x[held] for x in _answers(token, pair, before, got, n_docs))
        with np.errstate(divide="ignore", invalid="ignore"):
            logs = [np.where(x > 0, -np.log(x), np.inf) for x in (two / context, one / max(1, main_tokens))]
        steps = [np.where(np.isfinite(x), np.minimum(np.round(x * GRID), DEPTH - 1), DEPTH).astype(np.int64) for x in logs]
        cell, at, count = np.unique((_bucket(context) * (DEPTH + 1) + steps[0]) * (DEPTH + 1) + steps[1], return_inverse=True, return_counts=True)
        sums = [np.bincount(at, np.where(np.isfinite(x), x, 0), len(cell)).tolist() for x in logs]
        return [(int(c) // (DEPTH + 1) ** 2, int(c) % (DEPTH + 1) ** 2, int(n), x, y) for c, n, x, y in zip(cell, count, *sums, strict=True)]

    table = blocks.receive(own_replies, tally, "bucket int, cell bigint, n bigint, pair double, one double").groupBy("bucket", "cell").agg(*[F.sum(c).alias(c) for c in ("n", "pair", "one")])
    # BUCKETS * (DEPTH + 1) ** 2 rows at most, whatever the corpus
    cells = [(r["bucket"], r["cell"], float(r["n"]), r["pair"], r["one"]) for r in table.collect()]
    weights = learn_weights(cells, uniform)

    def rate(ids: list, starts: np.ndarray, buffer: bytes, got: pa.Table) -> list[tuple]:
        token, own, before, pair = _tokens(starts, buffer)
        one_main, one_tuning, two_main, two_tuning, context_main, context_tuning = _answers(token, pair, before, got, n_docs)
        one, two, context = one_main + one_tuning, two_main + two_tuning, context_main + context_tuning
        w = weights[_bucket(context)]
        p = w[:, 0] * two / np.maximum(context, 1) + w[:, 1] * one / max(1, train_tokens) + w[:, 2] * uniform
        n = len(ids)
        base = np.bincount(own, np.log10((one + 1) / (train_tokens + 1 * (distinct + 1))), n)
        model = np.bincount(own, np.log10(np.maximum(p, 1e-300)), n)
        tokens, known = np.bincount(own, minlength=n), np.bincount(own, one > 0, n).astype(np.int64)
        return [(i, _fold(i, parts) == out_fold, int(a), int(b), train_tokens, float(c), float(d)) for i, a, b, c, d in zip(ids, tokens, known, base, model, strict=True)]

    out = blocks.receive(own_replies, rate, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return out.withColumnRenamed("doc_id", key)
