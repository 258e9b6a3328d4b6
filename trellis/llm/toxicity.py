"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is folded to lower case with marks between words. Its character n-grams (in bytes of UTF-8; a mark may only begin
or end one) are hashed into buckets with an embedding each, so a misspelling or inflection that was never seen shares most
of its vectors with the word it comes from. Embeddings are averaged over windows of the text, and a linear softmax with two
classes scores each window; a text is as toxic as its most toxic window, so a passage in a long text is not averaged away.

With two classes, the softmax depends on w = W[1] - W[0] alone and a window's logit is the mean of E[b] @ w over its
n-grams: the gradient of every embedding is a multiple of w. Training so needs one number an n-gram for either pass, and
scoring one table look-up.

Bound: at most `most` labelled rows of each class are fitted (in one task); every text is scored, whole. Edge cases: null
and empty text score as the bare intercept; ids may be null or repeat; without examples of both classes every score is the
share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.llm.common import _BASE, _BASE_INV, _BYTE, _powers, mix, pieces_of, small_batches, text_buffer, text_of, trimmed
from trellis.llm.labels import calibrate, fitted, sample, sigmoid

GRAMS = (4, 5, 6)
#: A window's mean is over this many n-grams at least, so that a stray one in an almost empty window does not decide.
_FEW = 60
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 or 48 <= b <= 57 else 32 for b in range(256)], np.uint8)


def grams(data: np.ndarray, cuts: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: where n-grams begin and their buckets; data: folded bytes of texts that begin at cuts, each between marks.

    A word that repeats the one before it has none.
    """
    total = len(data)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _powers("up", _BASE, total)[:total])))
    down = _powers("down", _BASE_INV, total)
    first = np.flatnonzero((data[1:] != 32) & (data[:-1] == 32)) + 1
    last = np.flatnonzero((data[1:] == 32) & (data[:-1] != 32)) + 1
    words = (sums[last] - sums[first]) * down[first]
    again = np.flatnonzero(words[1:] == words[:-1]) + 1
    own = np.searchsorted(cuts, first, "right")
    again = again[own[again] == own[again - 1]]
    dull = np.zeros(total + 1, np.int8)
    dull[first[again] - 1] += 1
    dull[last[again]] -= 1
    dull = np.cumsum(dull[:-1], dtype=np.int8) > 0
    marks = np.concatenate((np.zeros(1, np.int32), np.cumsum(data == 32, dtype=np.int32)))
    for n in GRAMS:
        if total < n:
            continue
        last = total - n + 1
        inner = marks[n - 1 : total] == marks[1 : last + 1]  # no mark but at either end
        at = np.flatnonzero(inner)
        at = at[~dull[at]]
        yield at, (mix((sums[at + n] - sums[at]) * down[at] + np.uint64(n)) >> np.uint64(64 - bits)).astype(np.int32)


def folded(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes with a mark before and after each text, and where each begins and the last ends."""
    n = len(at) - 1
    out = np.full(len(data) + 2 * n, 32, np.uint8)
    out[np.arange(len(data)) + 2 * np.repeat(np.arange(n), np.diff(at)) + 1] = _FOLD[data]
    return out, at + 2 * np.arange(n + 1)


def windows(begin: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte of each window and its text: `size` bytes, half overlapping, the last one shorter."""
    long = np.diff(begin)
    number = np.maximum(1, -(-(long - size) // (size // 2)) + 1)
    text = np.repeat(np.arange(len(long)), number)
    k = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    first = begin[:-1][text] + k * (size // 2)
    return first, np.minimum(first + size, begin[1:][text]), text


class Model:
    """scores: a bucket's logit, float32; bias; scale and shift of the calibration."""

    def __init__(self, scores: np.ndarray, bias: float, scale: float, shift: float, size: int):
        self.scores, self.bias, self.scale, self.shift, self.size = scores, bias, scale, shift, size
        self.bits = int(np.log2(len(scores)))

    def raw(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        if len(at) < 2:
            return np.zeros(0)
        text, begin = folded(data, at)
        value, count = np.zeros(len(text) + 1), np.zeros(len(text) + 1, np.int64)
        for where, bucket in grams(text, begin[:-1], self.bits):
            value[where + 1] += self.scores[bucket]
            count[where + 1] += 1
        value, count = np.cumsum(value), np.cumsum(count)
        first, end, _ = windows(begin, self.size)
        mean = (value[end] - value[first]) / np.maximum(_FEW, count[end] - count[first])
        own = np.flatnonzero(np.concatenate(([True], np.diff(_) > 0)))
        return np.maximum.reduceat(mean, own) + self.bias

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale * self.raw(data, at) + self.shift)


def fit(texts: list[str], y: np.ndarray, weights: np.ndarray, *, bits: int = 17, dims: int = 16, size: int = 160, rounds: int = 40, rate: float = 1.0, least: int = 3, seed: int = 3) -> Model:
    """Joint training of embeddings and softmax by full-batch descent with momentum; every fifth text only calibrates.

    The first rounds average whole texts; later ones learn from the worst window of each text and, for clean texts, from
    all of their windows. An empty text counts as clean. n-grams of fewer than `least` texts keep no embedding.
    """
    rng = np.random.default_rng(seed)
    if len(np.unique(y)) < 2:
        p = float(y.mean()) if len(y) else 0.5
        return Model(np.zeros(1 << bits, np.float32), 0.0, 1.0, float(np.log((p + 1e-6) / (1 - p + 1e-6))), size)
    part = np.arange(len(y)) % 5 == 4
    if len(np.unique(y[part])) < 2 or len(np.unique(y[~part])) < 2:
        part[:] = False
    fitted = [t.encode("utf-8", "replace") for t, p in zip(texts, part, strict=True) if not p]
    target = y[~part]
    balance = np.where(target > 0, 0.5 / max(1, target.sum()), 0.5 / max(1, (1 - target).sum()))
    # n-grams by the half window that they begin in, a megabyte of text at a time; a window is the half it begins with and
    # the next of its text
    half = size // 2
    bulk, owner, lead, follow, total, own_texts = [], [], [], [], 0, np.zeros(1 << bits, np.int64)
    for group in _groups(fitted, 1 << 20):
        data, at = np.frombuffer(b"".join(fitted[i] for i in group), np.uint8), np.concatenate(([0], np.cumsum([len(fitted[i]) for i in group])))
        text, begin = folded(data, at)
        first, _, of = windows(begin, size)
        start, halves = begin[:-1], np.maximum(1, -(-np.diff(begin) // half))
        base = np.cumsum(halves) - halves
        cells, buckets = [], []
        for where, bucket in grams(text, start, bits):
            own = np.searchsorted(start, where, "right") - 1
            cells.append((base[own] + (where - start[own]) // half).astype(np.int32))
            buckets.append(bucket)
            seen = np.unique(bucket.astype(np.int64) * len(group) + own) // len(group)
            own_texts += np.bincount(seen, minlength=1 << bits)
        n = int(halves.sum())
        bulk.append((total, n, np.concatenate(cells) if cells else np.zeros(0, np.int32), np.concatenate(buckets) if buckets else np.zeros(0, np.int32)))
        k = base[of] + (first - start[of]) // half
        owner.append(of + group[0])
        lead.append(total + k)
        follow.append(np.where(k + 1 < base[of] + halves[of], total + k + 1, -1))
        total += n
    owner, lead, follow = map(np.concatenate, (owner, lead, follow))
    forward = lambda v: np.concatenate([np.bincount(c, v[b], n) for _, n, c, b in bulk])
    backward = lambda v: sum(np.bincount(b, v[at : at + n][c], 1 << bits) for at, n, c, b in bulk)
    count = forward(np.ones(1 << bits))
    pair = lambda v: v[lead] + np.where(follow >= 0, v[follow], 0)
    size_w = np.maximum(_FEW, pair(count))
    opening = np.flatnonzero(np.concatenate(([True], np.diff(owner) > 0)))
    per_text = np.diff(np.concatenate((opening, [len(owner)])))

    e = rng.uniform(-1, 1, (1 << bits, dims)) / dims
    w = rng.standard_normal(dims)
    bias, drift = 0.0, np.zeros(1 << bits)
    seen = own_texts >= least
    damp = np.where(seen, 1 / np.sqrt(np.maximum(1, own_texts)), 0)
    e[~seen] = 0
    for k in range(rounds):
        s = e @ w
        z = pair(forward(s)) / size_w + bias
        pull = np.zeros(len(z))
        if k < rounds // 6:
            mean = np.add.reduceat(z, opening) / per_text
            pull = np.repeat(balance * (sigmoid(mean) - target) / per_text, per_text)
        else:
            top = np.maximum.reduceat(z, opening)
            worst = np.flatnonzero(z == np.repeat(top, per_text))
            worst = worst[np.unique(owner[worst], return_index=True)[1]]
            pull[worst] = balance * (sigmoid(top) - target)
            clean = np.repeat((1 - target) * balance / per_text, per_text)
            pull += clean * sigmoid(z)
        share = pull / size_w
        back = np.bincount(lead, share, total)
        back += np.bincount(follow[follow >= 0], share[follow >= 0], total)
        g = backward(back)
        # a step along the damped gradient, as long as it moves the logits by `rate` at most (the top hundredth apart)
        drift = 0.7 * drift - damp * g / (np.abs(damp * g).max() + 1e-30)
        move = np.abs(pair(forward(drift)) / size_w)
        step = rate * (1 - 0.9 * k / rounds) / (np.quantile(move, 0.99) + 1e-30)
        turn = e.T @ g
        e += (step * drift / (w @ w))[:, None] * w
        w -= 0.01 * turn / (np.linalg.norm(turn) + 1e-30)
        bias -= rate * (pull.sum() + 0.5 * sigmoid(np.array(bias)))  # an empty text is one more clean example
    scores = (e @ w).astype(np.float32)
    model = Model(scores, float(bias), 1.0, 0.0, size)
    check = part if part.any() else ~part
    own = [t.encode("utf-8", "replace") for t, p in zip(texts, check, strict=True) if p]
    raw = np.concatenate([model.raw(np.frombuffer(b"".join(own[i] for i in g), np.uint8), np.concatenate(([0], np.cumsum([len(own[i]) for i in g])))) for g in _groups(own, 1 << 20)])
    raw, truth, heft = np.append(raw, bias), np.append(y[check], 0.0), np.append(weights[check], 0.05 * weights[check].sum())
    model.scale, model.shift = calibrate(raw, truth, heft, shift=True)
    return model


def _groups(texts: list[bytes], most: int) -> Iterator[list[int]]:
    """Numbers of consecutive texts of about `most` bytes together."""
    group, held = [], 0
    for i, t in enumerate(texts):
        group.append(i)
        held += len(t)
        if held >= most:
            yield group
            group, held = [], 0
    if group:
        yield group


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = 1500) -> Model:
    return fitted(sample(docs, labels, label, key=key, text=text, most=most), fit)


def score(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
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

    return rows.mapInArrow(trimmed(run), T.StructType([rows.schema["_row"], T.StructField("score", T.DoubleType())])).select("_row.*", "score")
