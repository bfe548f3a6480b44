"""Quality classifier: random-indexing word vectors, pooled per document, under a small network.

Random indexing gives every token a sparse random index vector (``nonzero`` entries of +1
or -1, from its hash) and adds up, over the whole corpus, the index vectors of its
neighbours: its context vector. Documents are the moments of their tokens' vectors. A
network of two layers in NumPy maps them to a logit, and a temperature fitted on rows kept
out of the training turns logits into calibrated probabilities.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwise.llm import text as X
from cellwise.llm.common import ship

FOLDS = 5
THRESHOLD = 0.3


@dataclass(frozen=True)
class Settings:
    """``rows``: hashed vocabulary (tokens that share a row share a vector), ``size`` of vectors,
    ``window`` neighbours on each side, at most ``sample`` labelled documents to fit on."""

    rows: int = 1 << 15
    size: int = 32
    nonzero: int = 2
    window: int = 2
    shrink: float = 10.0
    sample: int = 20_000
    hidden: int = 32
    epochs: int = 60
    batch: int = 256
    rate: float = 3e-3
    decay: float = 1e-4
    calibration: float = 0.2
    seed: int = 17
    chunks: int = 64
    fan: int = 64


def _row(hashes: np.ndarray, s: Settings) -> np.ndarray:
    return (hashes >> np.uint64(64 - int(math.log2(s.rows)))).astype(np.int64)


def context_sums(data: np.ndarray, offsets: np.ndarray, s: Settings, sums: np.ndarray) -> None:
    """Add the neighbours' index vectors (and token counts, in the last column) to ``sums``."""
    hashes, counts = X.hash_words(data, offsets, X.TOKENS)
    if not len(hashes):
        return
    row = _row(hashes, s)
    doc = np.repeat(np.arange(len(counts)), counts)
    places, signs = [], []
    for k in range(s.nonzero):
        drawn = X.mix(hashes + np.uint64(k + 1))
        places.append((drawn >> np.uint64(1)).astype(np.int64) % s.size)
        signs.append(np.where(drawn & np.uint64(1), 1.0, -1.0))
    wide = s.size + 1
    at, add = [row * wide + s.size], [np.ones(len(row))]
    for step in range(1, s.window + 1):
        near = np.flatnonzero(doc[step:] == doc[:-step])
        for place, sign in zip(places, signs):
            at += [row[near] * wide + place[near + step], row[near + step] * wide + place[near]]
            add += [sign[near + step], sign[near]]
    sums += np.bincount(np.concatenate(at), np.concatenate(add), sums.size).reshape(sums.shape).astype(np.int64)


def _collect(s: Settings):
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((s.rows, s.size + 1), np.int64)
        for batch in batches:
            data, offsets = X.utf8(batch["text"])
            for a, b in X.runs(offsets, 2 * X.SLICE_BYTES):
                context_sums(data, offsets[a : b + 1], s, sums)
        parts = np.split(sums, s.chunks)
        packed = [(p if np.abs(p).max() >= 1 << 31 else p.astype(np.int32)).tobytes() for p in parts]
        node = np.full(s.chunks, TaskContext.get().partitionId(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.arange(s.chunks), pa.int32()), pa.array(packed, pa.binary())], ["node", "chunk", "sums"])

    return collect


def _numbers(blob: bytes, s: Settings) -> np.ndarray:
    cells = s.rows // s.chunks * (s.size + 1)
    return np.frombuffer(blob, np.int32 if len(blob) == 4 * cells else np.int64).astype(np.int64)


def _add(s: Settings):
    def add(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        total = sum(_numbers(b, s) for b in rows["sums"].to_pylist())
        packed = (total if np.abs(total).max() >= 1 << 31 else total.astype(np.int32)).tobytes()
        return pa.table({"node": pa.array([key[0].as_py()], pa.int64()), "chunk": pa.array([key[1].as_py()], pa.int32()), "sums": pa.array([packed], pa.binary())})

    return add


def word_vectors(docs: DataFrame, s: Settings = Settings()) -> np.ndarray:
    """Vectors (rows x size) from the contexts of every token of every text.

    Each task adds its share into one matrix of fixed size, cut into chunks; the matrices
    are added in a tree, ``fan`` of one chunk at a time. Only the final matrix, whose size
    the settings fix, reaches the driver.
    """
    rows = ship(docs).select(F.col("text").cast("string").alias("text"))
    nodes = rows.rdd.getNumPartitions()
    schema = "node long, chunk int, sums binary"
    sums = rows.mapInArrow(_collect(s), schema)
    while nodes > 1:
        nodes = math.ceil(nodes / s.fan)
        sums = sums.withColumn("node", F.expr(f"node div {s.fan}")).groupBy("node", "chunk").applyInArrow(_add(s), schema)
    whole = np.zeros((s.rows, s.size + 1))
    for chunk, blob in sums.select("chunk", "sums").collect():
        part = _numbers(blob, s).reshape(-1, s.size + 1)
        whole[chunk * len(part) : (chunk + 1) * len(part)] += part
    contexts, counts = whole[:, :-1], whole[:, -1:]
    usual = contexts.sum(axis=0) / max(counts.sum(), 1.0)
    return ((contexts - counts * usual) / (counts + s.shrink)).astype(np.float32)


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray, s: Settings) -> np.ndarray:
    """Per document: means of its tokens' vectors, of their squares and of the products of
    neighbours, and the logarithm of the token count."""
    hashes, counts = X.hash_words(data, offsets, X.TOKENS)
    out = np.zeros((len(counts), 3 * s.size + 1), np.float32)
    out[:, -1] = np.log1p(counts)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    starts = (np.cumsum(counts) - counts)[some]
    each = vectors[_row(hashes, s)]
    n = counts[some][:, None]
    out[some, : s.size] = np.add.reduceat(each, starts, axis=0) / n
    out[some, s.size : 2 * s.size] = np.add.reduceat(each * each, starts, axis=0) / n
    products = np.zeros_like(each)
    np.multiply(each[1:], each[:-1], out=products[1:])
    products[starts] = 0
    out[some, 2 * s.size : 3 * s.size] = np.add.reduceat(products, starts, axis=0) / n
    return out


@dataclass
class Model:
    settings: Settings
    vectors: object  # broadcast of the word vectors
    centre: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float

    def logits(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.centre) / self.scale
        return np.maximum(x @ self.first + self.first_bias, 0) @ self.second + self.second_bias

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(features).astype(np.float64) / self.temperature, -500, 500)))


def fit_network(features: np.ndarray, labels: np.ndarray, s: Settings, vectors: object) -> Model:
    """Two layers by Adam on the training share, the temperature on the calibration share.

    With labels of one class only (or none) the network is left out and the prior decides.
    """
    rng = np.random.default_rng(s.seed)
    order = rng.permutation(len(labels))
    held = order[: int(len(order) * s.calibration)]
    train = order[len(held) :]
    centre = features[train].mean(axis=0) if len(train) else np.zeros(features.shape[1], np.float32)
    scale = features[train].std(axis=0) + 1e-6 if len(train) else np.ones(features.shape[1], np.float32)
    prior = float(np.clip((labels[train].sum() + 1) / (len(train) + 2), 1e-3, 1 - 1e-3))
    model = Model(s, vectors, centre, scale, np.zeros((features.shape[1], s.hidden)), np.zeros(s.hidden), np.zeros(s.hidden), math.log(prior / (1 - prior)), 1.0)
    if len(np.unique(labels[train])) < 2:
        return model
    x, y = (features[train] - centre) / scale, labels[train].astype(np.float64)
    weights = [rng.normal(0, math.sqrt(2 / x.shape[1]), (x.shape[1], s.hidden)), np.zeros(s.hidden), rng.normal(0, math.sqrt(1 / s.hidden), s.hidden), np.array(model.second_bias)]
    first, second, turn = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(s.epochs):
        shuffled = rng.permutation(len(y))
        for k in range(0, len(y), s.batch):
            part = shuffled[k : k + s.batch]
            hidden = np.maximum(x[part] @ weights[0] + weights[1], 0)
            error = (1 / (1 + np.exp(-(hidden @ weights[2] + weights[3]))) - y[part]) / len(part)
            back = np.outer(error, weights[2]) * (hidden > 0)
            slopes = [x[part].T @ back + s.decay * weights[0], back.sum(axis=0), hidden.T @ error + s.decay * weights[2], error.sum()]
            turn += 1
            for w, g, a, b in zip(weights, slopes, first, second):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                w -= s.rate * (a / (1 - 0.9**turn)) / (np.sqrt(b / (1 - 0.999**turn)) + 1e-8)
    model.first, model.first_bias, model.second, model.second_bias = weights[0], weights[1], weights[2], float(weights[3])
    if len(held) and len(np.unique(labels[held])) == 2:
        model.temperature = calibrated(model.logits(features[held]), labels[held])
    return model


def calibrated(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section on its logarithm.

    Labels count as (n + 1) / (n + 2) and 1 / (n + 2), so that a perfect split of few rows
    doesn't claim certainty.
    """
    ones = labels.sum()
    labels = np.where(labels > 0, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))

    def loss(log_t: float) -> float:
        z = logits / math.exp(log_t)
        return float(np.mean(np.logaddexp(0, z) - labels * z))

    low, high, gold = math.log(0.05), math.log(20), (math.sqrt(5) - 1) / 2
    while high - low > 1e-4:
        a, b = high - gold * (high - low), low + gold * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return math.exp((low + high) / 2)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Word vectors from all of ``docs``; the network from at most ``sample`` labelled rows
    that are not held out, those with the least hash of their doc_id."""
    vectors = docs.sparkSession.sparkContext.broadcast(word_vectors(docs, s))
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("double")).filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(~held_out())
    one = known.groupBy("doc_id").agg(F.avg("quality").alias("quality")).withColumn("quality", (F.col("quality") >= 0.5).cast("int"))
    chosen = F.broadcast(one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = X.utf8(batch["text"])
            for a, b in X.runs(offsets):
                found = pooled(data, offsets[a : b + 1], vectors.value, s)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), batch["quality"].slice(a, b - a), pa.array([f.tobytes() for f in found], pa.binary())], ["doc_id", "quality", "features"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(chosen, "doc_id")
    sample = rows.mapInArrow(describe, "doc_id long, quality int, features binary").toArrow()
    blobs, ids = sample["features"].to_pylist(), sample["doc_id"].to_numpy()
    order = sorted(range(len(blobs)), key=lambda k: (ids[k], blobs[k]))
    features = np.frombuffer(b"".join(blobs[k] for k in order), np.float32).reshape(len(blobs), 3 * s.size + 1)
    return fit_network(features, sample["quality"].to_numpy()[order] if len(blobs) else np.zeros(0), s, vectors)


def score(text: str | Column, model: Model) -> Column:
    """The probability of label 1 for every text, the empty and the null one included."""

    @F.arrow_udf("double")
    def probability(texts: pa.Array) -> pa.Array:
        data, offsets = X.utf8(texts)
        parts = [model.probabilities(pooled(data, offsets[a : b + 1], model.vectors.value, model.settings)) for a, b in X.runs(offsets)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return probability(text)


def classify(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``docs`` (doc_id, text, ...) with held_out, score and predicted (1 if score >= 0.3).

    Only texts enter a score. Null and empty texts count as documents without tokens. A
    null doc_id is not held out. Labels that are null, of unknown documents or held out are
    not used; repeated labels of a document are averaged. Without usable labels every score
    is one half. An empty table gives an empty table.
    """
    model = fit(docs, labels, s)
    scored = docs.withColumn("held_out", held_out()).withColumn("score", score(F.col("text").cast("string"), model))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
