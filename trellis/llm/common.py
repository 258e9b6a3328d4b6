"""What the corpus operators share: scratch tables, row identities, word hashing, disjoint sets, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.scratch import gone_at_exit, new_path


# ---------------------------------------------------------------- scratch
def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to a Parquet table in the shared folder and read back: cuts lineage, survives lost executors.

    The table goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    gone_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def smaller_than(df: DataFrame, rows: int) -> bool:
    """Whether df has at most that many rows; stops counting there."""
    return df.limit(rows + 1).count() <= rows


def lean(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if a count shows it within rows; else as it is, so the join shuffles."""
    return F.broadcast(df) if smaller_than(df, rows) else df


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python in batches of at most so many rows, for this session: Spark's default of 10,000 would hold
    tens of megabytes of text a batch on either side of the pipe. A lower setting is left alone; results do not depend on it.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def trimmed(run):
    """run, a function over a partition's batches, after which the worker gives freed memory back to the system: workers
    live on into later stages, beside an executor's heap that has grown."""
    def through(batches: Iterator) -> Iterator:
        import ctypes

        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        give = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
        if give:
            give(0)

    return through


def text_of(name: str) -> Column:
    """A text column as a string, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def running(values: Column) -> Column:
    """Running sums of an array of longs by doubling reach: log2(n) passes over it, no copy an element."""
    reach = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int"))
    far = lambda s, i, k: F.when(i >= F.call_function("shiftleft", F.lit(1), k), F.get(s, i - F.call_function("shiftleft", F.lit(1), k))).otherwise(F.lit(0).cast("long"))
    return F.aggregate(reach, values, lambda s, k: F.transform(s, lambda x, i: x + far(s, i, k)))


# ---------------------------------------------------------------- words
#: Random odd multipliers and byte values for polynomial hashes modulo 2**64, from a fixed seed.
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_BASE = np.uint64(int(_RNG.integers(0, 2**60)) * 8 + 3)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        full = np.full(max(n, 1 << 16), base, np.uint64)
        full[0] = 1
        have = _POWERS[name] = np.multiply.accumulate(full)
    return have


def word_hashes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For bytes of UTF-8 texts that begin at cuts: a 64-bit hash of each word and where it begins.

    Words end at space, \\x09-\\x0D or the end of a text; A-Z count as a-z.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = ~_SPACE[data]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    at = cuts[cuts < len(data)]
    begins[at] = word[at]
    at = at[at > 0] - 1
    ends[at] = word[at]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _powers("up", _BASE, len(data))[: len(data)])))
    return mix((sums[last] - sums[first]) * _powers("down", _BASE_INV, len(data))[first] + (last - first).astype(np.uint64)), first


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column without nulls, and its offsets from the first byte on; no copy."""
    import pyarrow as pa

    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)), at - at[0]


def pieces_of(batch, column: int, most: int = 1 << 20) -> Iterator:
    """A record batch cut into slices of about `most` bytes of text at least one row each, so arrays stay small."""
    col = batch.column(column)
    _, at = text_buffer(col)
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


# ---------------------------------------------------------------- sets
class Sets:
    """Disjoint sets over 0..n-1; the smallest member is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of the pairs that join something new: a spanning forest."""
    names: dict[int, int] = {}
    for p in pairs:
        for x in p:
            names.setdefault(x, len(names))
    sets = Sets(len(names))
    return [p for p in pairs if sets.join(names[p[0]], names[p[1]])]


def _united(batches: Iterator) -> Iterator:
    """(node, into) for every node on the edges of one task: the least node that it reaches."""
    import pyarrow as pa

    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    a, b = (np.concatenate([x[c].to_numpy() for x in batches]) for c in "ab")
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    sets = Sets(len(nodes))
    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        sets.join(x, y)
    into = nodes[np.fromiter(map(sets.find, range(len(nodes))), np.int64, len(nodes))]
    for i in range(0, len(nodes), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 50_000]), pa.array(into[i : i + 50_000])], ["node", "into"])


def components(edges: DataFrame, name: str = "components", *, task_edges: int = 500_000) -> DataFrame:
    """(node, component) for every node on an edge (a, b: long); component is the smallest node that it reaches.

    Contraction: in each round every node moves to the neighbour (or itself) of least pseudo-random rank, then to where that
    one moved, and edges are redrawn between those, so the nodes shrink by a constant factor whatever the graph's shape; no
    node's neighbours are ever gathered, only a minimum of them is kept. As soon as a count shows at most `task_edges`
    edges, they are united in one task. Where each node has come to is one written table, replaced each round by a single
    join, so no plan grows with the rounds. No row of the graph reaches the driver.
    """
    live = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    at: DataFrame | None = None

    def moved(at: DataFrame | None, step: DataFrame) -> DataFrame:
        if at is None:
            return step
        # a node of an earlier round that no live edge holds stays where it is
        nxt = step.select(F.col("node").alias("into"), F.col("into").alias("next"))
        return stored(at.join(nxt, "into", "left").select("node", F.coalesce("next", "into").alias("into")), f"{name}-at")

    k = 0
    while not smaller_than(live, task_edges):
        rank = lambda c, k=k: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("r"), F.col(c).alias("n"))
        both = live.select(F.col("a").alias("node"), rank("b").alias("to")).union(live.select(F.col("b").alias("node"), rank("a").alias("to")))
        # two numbers instead of a struct keep the aggregate a hash aggregate
        best = both.select("node", F.col("to.r").alias("r"), F.col("to.n").alias("n")).groupBy("node").agg(F.min("r").alias("r"), F.min_by("n", "r").alias("n"))
        own = F.xxhash64(F.col("node"), F.lit(k))
        one = stored(best.select("node", F.when(own <= F.col("r"), F.col("node")).otherwise(F.col("n")).alias("into")), f"{name}-hop")
        two = one.select(F.col("node").alias("into"), F.col("into").alias("next"))
        step = stored(one.join(two, "into").select("node", F.col("next").alias("into")), f"{name}-step")
        x, y = step.select(F.col("node").alias("a"), F.col("into").alias("x")), step.select(F.col("node").alias("b"), F.col("into").alias("y"))
        live = stored(live.join(x, "a").join(y, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{name}-live")
        at, k = moved(at, step), k + 1
    last = stored(live.repartition(1).mapInArrow(_united, "node long, into long"), f"{name}-last")
    out = moved(at, last)
    if k == 0:
        return out.select("node", F.col("into").alias("component"))
    least = out.groupBy("into").agg(F.min("node").alias("component"))
    return out.join(least, "into").select("node", "component")
