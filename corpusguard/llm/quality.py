"""Quality classifier: similarity-weighted votes of the nearest labelled documents in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import SPACE, hashed_words, mix, pieces
from .workspace import fold

#: Hashed byte pairs and words, bins of each style figure, latent dimensions, neighbours that vote, exponent of their weights.
PAIRS, WORDS, STEPS, DIMENSIONS, NEIGHBOURS, SHARPNESS = 2048, 2048, 16, 48, 32, 8
#: Dimensions beyond those kept, and rounds, of the search for singular vectors; rows of the sample held dense at a time.
SPARE, ROUNDS, DENSE = 16, 8, 256
#: Labelled rows of each class that the model is fitted on: the bound of what is collected and broadcast.
SAMPLE = 2048
#: Lowest score of an accepted document.
ACCEPT = 0.3

_PAIR = (mix(np.arange(1, 65537, dtype=np.uint64)) % np.uint64(PAIRS)).astype(np.int64)
_UPPER, _DIGIT, _MARK = (np.zeros(256, bool) for _ in range(3))
_UPPER[0x41:0x5B] = True
_DIGIT[0x30:0x3A] = True
_MARK[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True
STYLES = 9
FEATURES = PAIRS + WORDS + STYLES * (STEPS + 1)


def features(buffer: bytes, starts: np.ndarray) -> np.ndarray:
    """Term weights of the texts in a buffer: relative frequencies of hashed byte pairs and words, damped; and style figures (share of
    capitals, digits, marks and spaces, different words, the commonest word, words that repeat the one before, word length,
    text length) spread over bins."""
    n = len(starts)
    data = np.frombuffer(buffer, np.uint8)
    ends = np.append(starts[1:] - 1, len(buffer))
    length = np.maximum(ends - starts, 1)
    out = np.zeros((n, FEATURES), np.float32)
    if not len(data):
        return out
    codes = _PAIR[data[:-1].astype(np.int64) * 256 + data[1:]] if len(data) > 1 else np.zeros(0, np.int64)
    for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        if b - a > 1:
            out[k, :PAIRS] = np.bincount(codes[a : b - 1], minlength=PAIRS)
    out[:, :PAIRS] = np.log1p(out[:, :PAIRS] * (1000.0 / length)[:, None].astype(np.float32))
    hashes, docs = hashed_words(buffer, starts)
    count = np.bincount(docs, minlength=n)
    met, times = np.unique(docs * WORDS + (hashes % np.uint64(WORDS)).astype(np.int64), return_counts=True)
    out[met // WORDS, PAIRS + met % WORDS] = np.log1p(times * (200.0 / np.maximum(count, 1))[met // WORDS])
    runs = np.sort((docs.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
    first = np.flatnonzero(np.append(True, runs[1:] != runs[:-1])) if len(runs) else np.zeros(0, np.int64)
    own = (runs[first] >> np.uint64(44)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, own, np.diff(np.append(first, len(runs))))
    words = np.maximum(count, 1)
    again = (hashes[1:] == hashes[:-1]) & (docs[1:] == docs[:-1]) if len(docs) else np.zeros(0, bool)
    repeats = np.bincount(docs[1:][again], minlength=n) if len(docs) else np.zeros(n)
    sums = [np.concatenate([[0], np.cumsum(t[data])]) for t in (_UPPER, _DIGIT, _MARK, SPACE)]
    shares = [(s[ends] - s[starts]) / length for s in sums]
    styles = [np.sqrt(shares[0]), np.sqrt(shares[1]), np.sqrt(shares[2]), shares[3], np.bincount(own, minlength=n) / words, np.sqrt(most / words), np.sqrt(repeats / words), np.minimum(1, length / words / 20), np.minimum(1, np.log10(length) / 6)]
    for k, x in enumerate(styles):
        x = np.clip(x, 0, 1) * (STEPS - 1)
        low = x.astype(np.int64)
        at = PAIRS + WORDS + k * (STEPS + 1)
        out[np.arange(n), at + low] += (1 - (x - low)).astype(np.float32) * 6
        out[np.arange(n), at + low + 1] += (x - low).astype(np.float32) * 6
    out[ends == starts] = 0
    return out


@dataclass
class Model:
    prior: float
    idf: np.ndarray
    basis: np.ndarray  # features x dimensions
    vectors: np.ndarray  # dimensions x labelled rows, of unit length
    labels: np.ndarray


class Rows:
    """Feature rows held by their cells that aren't 0."""

    def __init__(self, packed: list[bytes]):
        cells = [np.frombuffer(x, [("at", "<u2"), ("value", "<f4")]) for x in packed]
        self.ends = np.cumsum([len(c) for c in cells]) if cells else np.zeros(0, np.int64)
        flat = np.concatenate(cells) if cells else np.zeros(0, [("at", "<u2"), ("value", "<f4")])
        self.at, self.value = flat["at"].astype(np.int64), flat["value"].copy()
        self.row = np.repeat(np.arange(len(cells)), [len(c) for c in cells])

    def __len__(self) -> int:
        return len(self.ends)

    def dense(self) -> Iterator[np.ndarray]:
        for a in range(0, len(self), DENSE):
            b = min(a + DENSE, len(self))
            own = slice(int(self.ends[a - 1]) if a else 0, int(self.ends[b - 1]))
            out = np.zeros((b - a, FEATURES), np.float32)
            out[self.row[own] - a, self.at[own]] = self.value[own]
            yield out


def packed(row: np.ndarray) -> bytes:
    """The cells of a feature row that aren't 0."""
    at = np.flatnonzero(row)
    out = np.empty(len(at), [("at", "<u2"), ("value", "<f4")])
    out["at"], out["value"] = at, row[at]
    return out.tobytes()


def fit(rows: list[bytes], labels: np.ndarray, prior: float) -> Model:
    """The singular vectors of the weighted sample, and its rows in their space. With no labelled text every score is the prior.

    The vectors are those of the largest singular values, found by repeated products with the rows, which are made
    dense a few at a time: what is held follows the sample's bound and the number of features.
    """
    good = [k for k, r in enumerate(rows) if r]
    sample, labels = Rows([rows[k] for k in good]), labels[good]
    if not len(sample):
        return Model(prior, np.ones(FEATURES, np.float32), np.zeros((FEATURES, 1), np.float32), np.zeros((1, 0), np.float32), labels)
    idf = np.log1p(len(sample) / (1.0 + np.bincount(sample.at, minlength=FEATURES))).astype(np.float32)
    sample.value *= idf[sample.at]
    sample.value /= np.sqrt(np.bincount(sample.row, sample.value.astype(np.float64) ** 2)).astype(np.float32)[sample.row]
    kept = min(DIMENSIONS, len(sample))
    basis = np.linalg.qr(np.random.default_rng(7).standard_normal((FEATURES, min(kept + SPARE, len(sample)))))[0].astype(np.float32)
    for _ in range(ROUNDS):
        basis = np.linalg.qr(sum(x.T @ (x @ basis) for x in sample.dense()).astype(np.float64))[0].astype(np.float32)
    seen = np.concatenate([x @ basis for x in sample.dense()])
    turn = np.linalg.eigh((seen.T @ seen).astype(np.float64))[1][:, ::-1][:, :kept].astype(np.float32)
    basis, y = np.ascontiguousarray(basis @ turn), seen @ turn
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    return Model(prior, idf, basis, np.ascontiguousarray(y.T), labels.astype(np.float32))


def score(model: Model, rows: np.ndarray) -> np.ndarray:
    """Exact cosine products with all labelled rows, block by block; the nearest vote with weight similarity ** SHARPNESS."""
    out = np.full(len(rows), model.prior)
    k = min(NEIGHBOURS, model.vectors.shape[1])
    for a in range(0, len(rows) if k else 0, 256):
        x = rows[a : a + 256] * model.idf
        y = x @ model.basis
        norm = np.linalg.norm(y, axis=1, keepdims=True)
        near = (y / np.maximum(norm, 1e-12)) @ model.vectors
        # all rows as similar as the k-th vote, so ties don't depend on an order
        least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k][:, None]
        weight = np.where(near >= least, np.maximum(near, 0), 0).astype(np.float64) ** SHARPNESS
        total = weight.sum(axis=1)
        some = total > 0
        out[a : a + 256][some] = (weight @ model.labels)[some] / total[some]
    return np.clip(out, 0.0, 1.0)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, buffer, starts in pieces(batch.column(1)):
            rows = features(buffer, starts)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array([packed(r) for r in rows], pa.binary())], ["label", "row"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", held_out: tuple[int, int] = (5, 0), sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` rows of each class, chosen by a hash of the key among labelled rows whose fold isn't held out.

    The bound makes what is collected (2 * sample rows of FEATURES cells at most) and broadcast the same for any corpus.
    Of labels, or texts, that share a key the smallest is taken.
    """
    usable = labels.select(F.col(key).alias(key), F.col(label).cast("int").alias("label")).filter(f"label in (0, 1) and {key} is not null").filter(fold(key, held_out[0]) != held_out[1])
    usable = usable.groupBy(key).agg(F.min("label").alias("label"))
    shares = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    n = sum(shares.values())
    prior = shares.get(1, 0) / n if n else 0.5
    picked = None
    for value in (0, 1):
        part = usable.filter(F.col("label") == value).orderBy(F.xxhash64(key), key).limit(sample)
        picked = part if picked is None else picked.unionByName(part)
    found = docs.select(F.col(key), F.col(text).alias("_text")).join(F.broadcast(picked), key).groupBy(key).agg(F.first("label").alias("label"), F.min("_text").alias("_text"))
    rows = found.select("label", "_text", key).sortWithinPartitions(key).mapInArrow(_features, "label int, row binary").collect()
    return fit([bytes(r["row"]) for r in rows], np.array([r["label"] for r in rows], np.float32), prior)


def scorer(spark: SparkSession, model: Model):
    """The score of a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scores(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            parts = [score(shared.value, features(buffer, starts)) for _, _, buffer, starts in pieces(column)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return scores


def score_quality(docs: DataFrame, labels: DataFrame, training: DataFrame | None = None, key: str = "doc_id", text: str = "text", held_out: tuple[int, int] = (5, 0)) -> DataFrame:
    """key, held_out, score and predicted of each row of docs.

    score: from 0 to 1, higher where label 1 is likelier; predicted: 1 from ACCEPT on. The whole text is the only input.
    A null or empty text scores the share of label 1 among the labels learned from (0.5 without any). Equal texts score
    alike; null and repeated keys get a row each; other columns don't matter; no rows give no rows. `training`: the
    texts that the labels are of (default: docs); the labels of a null key, or neither 0 nor 1, are not used.
    """
    rows = docs.select(F.col(key), F.col(text).alias("_text"))
    scores = scorer(docs.sparkSession, train(training if training is not None else docs, labels, key=key, text=text, held_out=held_out))
    out = rows.select(key, (fold(key, held_out[0]) == held_out[1]).alias("held_out"), scores(F.col("_text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, training: DataFrame | None = None, key: str = "doc_id", text: str = "text", held_out: tuple[int, int] = (5, 0)) -> DataFrame:
    """The rows of docs that score_quality() predicts 1 for, all columns."""
    scores = scorer(docs.sparkSession, train(training if training is not None else docs, labels, key=key, text=text, held_out=held_out))
    name = "_score"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, scores(F.col(text))).filter(F.col(name) >= ACCEPT).drop(name)
