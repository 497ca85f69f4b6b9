"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Tokens are runs of letters and digits, and runs of other solid bytes; a token's number is its
hash modulo ``VOCABULARY``.  Each number has a fixed sparse random index vector.  A token's
word vector is the sum, over all its occurrences in *all* documents, of the index vectors of
its two neighbours.  A document is the mean of its (unit) word vectors, and the mean of the
products of neighbouring tokens' index vectors, which binds their order and repetition.

The network (tanh, then a logistic unit) is trained in NumPy on at most ``FIT_ROWS`` labelled
rows, those of the smallest hashes of doc_id; this bound limits what the driver holds.  Rows
whose crc32(doc_id as text) modulo 4 is 2 are never trained on.  A fifth of the training rows
is kept aside to fit the temperature that calibrates the probabilities.

What a partition gathers for the word vectors is at most VOCABULARY rows, summed in the JVM;
the driver gets VOCABULARY x DIM sums and broadcasts them: 2 MB, whatever the corpus.

Defined cases: null, empty and white texts have the zero vector and are scored like any other;
labels that are null, or whose doc_id is null or unknown, are left out; with no labels every
score is 0.5, with labels of one class the smoothed share of that class; repeated rows are
scored each for itself; extra columns are ignored by :func:`scores` and kept by :func:`accepted`.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settled, small_batches
from .textbytes import ALNUM, SOLID, RunHasher, blocks, column_bytes, tidy

VOCABULARY, DIM, NONZERO = 1 << 14, 32, 4
FIT_ROWS = 20_000
HIDDEN, EPOCHS, RATE, BATCH, DECAY = 32, 60, 0.01, 256, 1e-4
THRESHOLD = 0.7
HELD_OUT = 2
FEATURES = 2 * DIM


def index_vectors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fixed random places and signs by token number, and the same as a dense table."""
    rng = np.random.default_rng(20240607)
    places = np.argsort(rng.random((VOCABULARY, DIM)), axis=1)[:, :NONZERO]
    signs = rng.integers(0, 2, (VOCABULARY, NONZERO)) * 2 - 1
    dense = np.zeros((VOCABULARY, DIM), np.float32)
    np.put_along_axis(dense, places, signs.astype(np.float32), axis=1)
    return places, signs, dense


def tokens(data: np.ndarray, offsets: np.ndarray, hasher: RunHasher) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers of a block, and each document's first token."""
    kind = SOLID[data].astype(np.int8) + (ALNUM[data] & SOLID[data])
    change = np.ones(len(data), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], len(data))
    solid = kind[starts] > 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[solid], ends[solid]
    return (hasher(data, starts, ends) >> np.uint64(20)).astype(np.int64) % VOCABULARY, np.searchsorted(starts, offsets)


@tidy
def _gather(batches):
    places, signs, _ = index_vectors()
    hasher, sums, seen = RunHasher(3), np.zeros(VOCABULARY * DIM), np.zeros(VOCABULARY, bool)
    for batch in batches:
        data, offsets = column_bytes(batch.column(0))
        for a, b in blocks(offsets):
            word, first = tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], hasher)
            if len(word) < 2:
                continue
            near = np.ones(len(word) - 1, bool)
            border = first[1:-1] - 1
            near[border[(border >= 0) & (border < len(near))]] = False
            left, right = word[:-1][near], word[1:][near]
            seen[left] = seen[right] = True
            for me, other in ((left, right), (right, left)):
                for k in range(NONZERO):
                    sums += np.bincount(me * DIM + places[other, k], weights=signs[other, k], minlength=VOCABULARY * DIM)
    rows = np.flatnonzero(seen)
    table = sums.reshape(VOCABULARY, DIM)[rows].astype(np.int64)
    if len(rows):
        yield pa.RecordBatch.from_arrays([pa.array(rows), *[pa.array(table[:, d]) for d in range(DIM)]], ["word", *[f"d{d}" for d in range(DIM)]])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit word vectors by token number, from all documents; zero where a token never occurs."""
    schema = "word long, " + ", ".join(f"d{d} long" for d in range(DIM))
    found = small_batches(docs).select(F.col("text").cast("string")).mapInArrow(_gather, schema).groupBy("word").agg(*[F.sum(f"d{d}").alias(f"d{d}") for d in range(DIM)]).collect()
    out = np.zeros((VOCABULARY, DIM), np.float32)
    for r in found:
        out[r[0]] = r[1:]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray, dense: np.ndarray, hasher: RunHasher) -> np.ndarray:
    """Feature rows of a block of documents."""
    word, first = tokens(data, offsets, hasher)
    out = np.zeros((len(offsets) - 1, FEATURES), np.float32)
    count = np.diff(first)
    full = np.flatnonzero(count)
    if len(full):
        out[full, :DIM] = np.add.reduceat(vectors[word], first[:-1][full], axis=0) / count[full, None]
        bound = dense[word]
        bound[:-1] *= dense[word[1:]]
        bound[first[1:][full] - 1] = 0
        out[full, DIM:] = np.add.reduceat(bound, first[:-1][full], axis=0) / np.maximum(count[full, None] - 1, 1)
    return out


@tidy
def _pool(batches, vectors: np.ndarray):
    dense, hasher = index_vectors()[2], RunHasher(3)
    for batch in batches:
        data, offsets = column_bytes(batch.column(1))
        parts = [pooled(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], vectors, dense, hasher) for a, b in blocks(offsets)]
        flat = np.concatenate(parts).ravel() if parts else np.zeros(0, np.float32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch.column(0)) + 1, dtype=np.int32) * FEATURES), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "features"])


@dataclass
class Network:
    """Standardised inputs, one hidden layer, and a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
    """Fits network and temperature; constant scores where there are no two classes to tell apart."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    n = x.shape[1]
    if len(np.unique(y)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Network(np.zeros(n), np.ones(n), np.zeros((n, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    aside, fit = order[: len(x) // 5], order[len(x) // 5 :]
    if not len(aside) or len(np.unique(y[fit])) < 2:
        aside = fit = order
    mean, scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-6
    p = [rng.normal(0, 1 / np.sqrt(n), (n, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    z, step = (x - mean) / scale, 0
    for _ in range(EPOCHS):
        order = rng.permutation(fit)
        for k in range(0, len(order), BATCH):
            rows = order[k : k + BATCH]
            hidden = np.tanh(z[rows] @ p[0] + p[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3], -30, 30))) - y[rows]) / len(rows)
            back = error[:, None] * p[2] * (1 - hidden**2)
            step += 1
            for i, g in enumerate((z[rows].T @ back + DECAY * p[0], back.sum(axis=0), hidden.T @ error + DECAY * p[2], np.array([error.sum()]))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    logit = net.logits(x[aside])
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 121))
    loss = [np.mean(np.logaddexp(0, -np.where(y[aside] > 0.5, 1, -1) * logit / t)) for t in grid]
    net.temperature = float(grid[int(np.argmin(loss))])
    return net


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == HELD_OUT


@tidy
def _score(batches, net: Network):
    for batch in batches:
        lists = batch.column(1)
        x = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
        s = net.scores(x)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])


def fit(features: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Network:
    """Trains on the features (doc_id, features) of labelled rows that are not held out."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    joined = settled(features.join(known, "doc_id"))
    # cut by hash first, else every task would send the driver up to fit_rows rows
    share = min(1.0, (1.2 * fit_rows + 1000) / max(1, joined.count()))
    rows = joined.where(rank <= int(share * (1 << 40))).orderBy(rank, "doc_id", "quality", "features").limit(fit_rows).select("features", "quality").collect()
    x = np.array([r[0] for r in rows], np.float32).reshape(-1, FEATURES)
    return train(x, np.array([r[1] for r in rows]))


def scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    context = docs.sparkSession.sparkContext
    vectors = context.broadcast(word_vectors(docs))
    features = settled(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda it: _pool(it, vectors.value), "doc_id long, features array<float>"))
    net = fit(features, labels, fit_rows)
    out = features.mapInArrow(lambda it: _score(it, net), "doc_id long, score double, predicted int")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


@tidy
def _accept(batches, vectors: np.ndarray, net: Network, at: int):
    dense, hasher = index_vectors()[2], RunHasher(3)
    for batch in batches:
        data, offsets = column_bytes(batch.column(at))
        for a, b in blocks(offsets):
            x = pooled(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], vectors, dense, hasher)
            yield batch.slice(a, b - a).filter(pa.array(net.scores(x) >= THRESHOLD))


def accepted(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The documents the classifier does not reject, with all their columns; no join moves their texts."""
    context = docs.sparkSession.sparkContext
    vectors = context.broadcast(word_vectors(docs))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    light = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda it: _pool(it, vectors.value), "doc_id long, features array<float>")
    net = fit(settled(light.join(known, "doc_id", "left_semi")), labels, fit_rows)
    at = docs.columns.index("text")
    return docs.mapInArrow(lambda it: _accept(it, vectors.value, net, at), docs.schema)


def crc_mod(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 4
