"""Quality by random-indexing word vectors pooled per document and a two-layer network, both in numpy.

Tokens are runs of word characters or of other signs, in UTF-8 bytes with their case; a word in capitals and a word that
repeats the one before stand for themselves as two special tokens. Every token has a sparse random index vector, made
from a hash. Over all documents, each token's vector sums its own index vector and those of its neighbours (random
indexing); tokens share `2**bits` hashed rows, so the table's size is fixed and what is summed into it is the whole corpus.
Partial tables are summed by rows in a streaming way, and only the finished table reaches the driver. What is summed are
multiples of one half, which floating point adds exactly, so a task that runs again or ends late changes no score.

A document's input is the mean of its tokens' vectors and, over windows of tokens, the greatest and least mean in each
dimension. A network of two layers is fitted with Adam to at most `most` labelled rows of each class, and one temperature
is fitted on rows left aside. Every text is scored, whole.

Edge cases: null, empty and blank text have a zero input; ids may be null or repeat; without examples of both classes every
score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.llm.common import _BASE, _BASE_INV, _powers, mix, pieces_of, small_batches, text_buffer, text_of
from trellis.llm.labels import calibrate, fitted, sample, sigmoid

_RAW = np.random.default_rng(11).integers(0, 2**64, 256, dtype=np.uint64)
_KIND = np.array([0 if b == 32 or 9 <= b <= 13 else 1 if b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 2 for b in range(256)], np.int8)
_CAPS, _AGAIN = 0, 1
_CHUNK = 256


def tokens(data: np.ndarray, cuts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row of the table and first byte of each token of the texts that begin at cuts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _KIND[data]
    edge = np.concatenate(([True], kind[1:] != kind[:-1]))
    edge[cuts[cuts < len(data)]] = True
    first = np.flatnonzero(edge)
    last = np.append(first[1:], len(data))
    solid = kind[first] > 0
    first, last = first[solid], last[solid]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_RAW[data] * _powers("up", _BASE, len(data))[: len(data)])))
    value = mix((sums[last] - sums[first]) * _powers("down", _BASE_INV, len(data))[first] + (last - first).astype(np.uint64))
    row = (value >> np.uint64(64 - bits)).astype(np.int64)
    upper, lower = (np.concatenate(([0], np.cumsum((data >= a) & (data <= b)))) for a, b in ((65, 90), (97, 122)))
    row[(upper[last] - upper[first] > 1) & (lower[last] == lower[first])] = _CAPS
    word = kind[first] == 1
    at = np.flatnonzero(word)
    row[at[1:][value[at[1:]] == value[at[:-1]]]] = _AGAIN
    return row, first


def index_vectors(bits: int, dims: int) -> np.ndarray:
    """Sparse ternary vectors: an eighth of the entries is 1 or -1."""
    draw = np.random.default_rng([bits, dims]).integers(0, 16, (1 << bits, dims))
    return (draw == 0).astype(np.float32) - (draw == 1)


def summed(rows: np.ndarray, text: np.ndarray, table: np.ndarray, index: np.ndarray, reach: int = 2) -> None:
    """Adds to the table what tokens see of themselves and of their neighbours in the same text."""
    near = np.zeros((len(rows), index.shape[1]), np.float32)
    near += index[rows]
    for k in range(1, reach + 1):
        same = (text[k:] == text[:-k])[:, None]
        near[k:] += 0.5 * index[rows[:-k]] * same
        near[:-k] += 0.5 * index[rows[k:]] * same
    order = np.argsort(rows, kind="stable")
    cut = np.flatnonzero(np.concatenate(([True], np.diff(rows[order]) > 0)))
    table[rows[order[cut]]] += np.add.reduceat(near[order], cut, axis=0)


def word_vectors(docs: DataFrame, *, text: str = "text", bits: int = 14, dims: int = 32) -> np.ndarray:
    """Unit word vectors from all documents."""
    small_batches(docs.sparkSession)

    def partial(batches: Iterator) -> Iterator:
        import pyarrow as pa

        index, table = index_vectors(bits, dims), np.zeros((1 << bits, dims), np.float32)
        for batch in batches:
            for part in pieces_of(batch, 0, 1 << 20):
                data, at = text_buffer(part.column(0))
                rows, first = tokens(data, at[:-1], bits)
                if len(rows):
                    summed(rows, np.searchsorted(at, first, "right"), table, index)
        for k in range(0, 1 << bits, _CHUNK):
            if table[k : k + _CHUNK].any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([table[k : k + _CHUNK].tobytes()], pa.binary())], ["chunk", "sums"])

    def total(batches: Iterator) -> Iterator:
        import pyarrow as pa

        have: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, b in zip(batch["chunk"].to_pylist(), batch["sums"].to_pylist(), strict=True):
                have[k] = have.get(k, 0.0) + np.frombuffer(b, np.float32).astype(np.float64)
        for k, v in have.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v.astype(np.float32).tobytes()], pa.binary())], ["chunk", "sums"])

    kind = "chunk int, sums binary"
    out = np.zeros((1 << bits, dims), np.float32)
    for r in docs.select(text_of(text).alias("t")).mapInArrow(partial, kind).repartition((1 << bits) // _CHUNK, "chunk").mapInArrow(total, kind).collect():
        out[r.chunk : r.chunk + _CHUNK] = np.frombuffer(r.sums, np.float32).reshape(-1, dims)
    return out / np.maximum(1e-6, np.linalg.norm(out, axis=1, keepdims=True))


def pooled(data: np.ndarray, at: np.ndarray, vectors: np.ndarray, size: int = 64) -> np.ndarray:
    """A row of mean, greatest and least window means for each text."""
    n, dims = len(at) - 1, vectors.shape[1]
    out = np.zeros((n, 3 * dims))
    rows, first = tokens(data, at[:-1], int(np.log2(len(vectors))))
    if not len(rows):
        return out
    text = np.searchsorted(at, first, "right") - 1
    opening = np.flatnonzero(np.concatenate(([True], np.diff(text) > 0)))
    place = np.arange(len(rows)) - np.repeat(opening, np.diff(np.append(opening, len(rows))))
    cut = np.flatnonzero(place % size == 0)
    sums = np.add.reduceat(vectors[rows].astype(np.float64), cut, axis=0)
    long = np.diff(np.append(cut, len(rows)))
    owner = text[cut]
    start = np.flatnonzero(np.concatenate(([True], np.diff(owner) > 0)))
    own, whole = owner[start], np.add.reduceat(long, start)[:, None]
    out[own, :dims] = np.add.reduceat(sums, start, axis=0) / whole
    # a short last window counts in so far as it is filled
    means = sums / np.maximum(long, size // 4)[:, None]
    out[own, dims : 2 * dims] = np.maximum.reduceat(means, start, axis=0)
    out[own, 2 * dims :] = np.minimum.reduceat(means, start, axis=0)
    return out


class Network:
    """Two layers: tanh of a hidden layer, one logit; inputs are standardised; scale is the inverse temperature."""

    def __init__(self, vectors: np.ndarray, mean, spread, w1, b1, w2, b2, scale: float):
        self.vectors, self.mean, self.spread, self.w1, self.b1, self.w2, self.b2, self.scale = vectors, mean, spread, w1, b1, w2, b2, scale

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.spread @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale * self.raw(pooled(data, at, self.vectors)))


def fit(texts: list[str], y: np.ndarray, weights: np.ndarray, vectors: np.ndarray, *, hidden: int = 24, rounds: int = 400, seed: int = 5) -> Network:
    rng = np.random.default_rng(seed)
    raw = [t.encode("utf-8", "replace") for t in texts]
    inputs = 3 * vectors.shape[1]
    x = np.concatenate([pooled(np.frombuffer(b, np.uint8), np.array([0, len(b)]), vectors) for b in raw]) if raw else np.zeros((0, inputs))
    if len(np.unique(y)) < 2:
        p = float(y.mean()) if len(y) else 0.5
        return Network(vectors, np.zeros(inputs), np.ones(inputs), np.zeros((inputs, 1)), np.zeros(1), np.zeros(1), float(np.log((p + 1e-6) / (1 - p + 1e-6))), 1.0)
    aside = np.arange(len(y)) % 5 == 4
    if len(np.unique(y[aside])) < 2 or len(np.unique(y[~aside])) < 2:
        aside[:] = False
    mean, spread = x[~aside].mean(0), x[~aside].std(0) + 1e-3
    u, t, c = (x[~aside] - mean) / spread, y[~aside], weights[~aside]
    c = c / c.sum()
    p = [rng.standard_normal((inputs, hidden)) / np.sqrt(inputs), np.zeros(hidden), rng.standard_normal(hidden) / np.sqrt(hidden), np.zeros(1)]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    for k in range(1, rounds + 1):
        h = np.tanh(u @ p[0] + p[1])
        d = c * (sigmoid(h @ p[2] + p[3]) - t)
        back = d[:, None] * p[2] * (1 - h * h)
        for i, g in enumerate((u.T @ back + 1e-4 * p[0], back.sum(0), h.T @ d + 1e-4 * p[2], d.sum(keepdims=True))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] -= 0.01 * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.999**k)) + 1e-8)
    net = Network(vectors, mean, spread, p[0], p[1], p[2], float(p[3][0]), 1.0)
    check = aside if aside.any() else ~aside
    net.scale, _ = calibrate(net.raw(x[check]), y[check], weights[check], shift=False)
    return net


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = 2500) -> Network:
    vectors = word_vectors(docs, text=text)
    return fitted(sample(docs, labels, label, key=key, text=text, most=most), lambda *rows: fit(*rows, vectors))


def score(docs: DataFrame, model: Network, *, text: str = "text") -> DataFrame:
    """docs with `score` added (a column of that name is replaced)."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c != "score"]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), text_of(text).alias("_text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in pieces_of(batch, 1, 1 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sent.value.score(*text_buffer(part.column(1))), pa.float64())], ["_row", "score"])

    return rows.mapInArrow(run, T.StructType([rows.schema["_row"], T.StructField("score", T.DoubleType())])).select("_row.*", "score")
