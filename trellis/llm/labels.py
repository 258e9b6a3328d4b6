"""What both classifiers share: a bounded sample of labelled texts, fitting in a task, and calibration."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trellis.llm.common import text_of, trimmed


def held_out(key: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, *, key: str, text: str, most: int, most_bytes: int = 64 << 20) -> DataFrame:
    """(k, t, y, w): at most `most` labelled texts a class, outside the held-out fold, chosen by a hash of the id.

    An id's text is the least by hash if rows repeat it. Texts come in the order of that hash of the id until they hold
    `most_bytes` bytes together (classes taking turns). Weights restore the classes' shares among all labelled rows; rows
    whose label is neither 0 nor 1 are no examples.
    """
    own = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("k").isNotNull() & ~held_out(F.col("k")))
    counts = {r.y: r["count"] for r in own.groupBy("y").count().collect()}
    picked = None
    for y in (0, 1):
        few = own.where(F.col("y") == y).groupBy("k", "y").agg(F.count("*")).select("k", "y").orderBy(F.xxhash64("k"), "k").limit(most)
        picked = few if picked is None else picked.union(few)
    rows = docs.select(F.col(key).alias("k"), text_of(text).alias("t")).join(F.broadcast(picked), "k")
    rows = rows.groupBy("k", "y").agg(F.min_by("t", F.xxhash64("t")).alias("t"))
    turn = W.partitionBy("y").orderBy(F.xxhash64("k"), "k")  # over 2 * most rows at most
    rows = rows.withColumn("turn", F.row_number().over(turn)).withColumn("held", F.sum(F.octet_length("t")).over(W.orderBy("turn", "y")))
    return rows.where(F.col("held") <= most_bytes).select("k", "t", "y", F.when(F.col("y") == 1, float(counts.get(1, 0))).otherwise(float(counts.get(0, 0))).alias("w"))


def fitted(rows: DataFrame, fit: Callable):
    """fit(texts, y, weights) of sampled rows, run in one task: neither texts nor what fitting needs reach the driver."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches).sort_by("k")
        y, total = table["y"].to_numpy().astype(np.float64), table["w"].to_numpy()
        weights = total / np.where(y > 0, max(1, y.sum()), max(1, (1 - y).sum()))
        model = fit(table["t"].to_pylist(), y, weights / weights.mean() if len(weights) else weights)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    got = rows.repartition(1).mapInArrow(trimmed(run), "model binary").first()
    return pickle.loads(got.model) if got else fit([], np.zeros(0), np.zeros(0))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def calibrate(z: np.ndarray, y: np.ndarray, w: np.ndarray, *, shift: bool) -> tuple[float, float]:
    """Scale a > 0 (an inverse temperature) and, if asked for, shift c that fit sigmoid(a z + c) to y, by descent on log a and c."""
    best = (1.0, 0.0)
    if len(np.unique(y)) < 2:
        return best

    def loss(a, c):
        p = np.clip(sigmoid(a * z + c), 1e-9, 1 - 1e-9)
        return float(-(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / w.sum()) + 1e-3 * np.log(a) ** 2

    low = loss(*best)
    step = 1.0
    while step > 0.01:
        moves = [(best[0] * np.exp(i * step), best[1] + j * step) for i in (-1, 0, 1) for j in ((-1, 0, 1) if shift else (0,))]
        at = min(moves, key=lambda m: loss(*m))
        if loss(*at) < low - 1e-12:
            best, low = at, loss(*at)
        else:
            step /= 2
    return float(best[0]), float(best[1])
