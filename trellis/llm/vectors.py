"""Embedding near-duplicates by sorted projection passes.

Each pass draws random hyperplanes; the signs of a vector's projections, one bit each, are concatenated and vectors are put
in that lexicographic order. Within a sorted partition every vector is compared with the `window` before it, by cosine in
double precision, and pairs at or above the threshold are united. Passes are independent, so what one misses another
finds; the united pairs of all passes make components.

A window is bounded, so passes alone lose links. With `complete` (the default) an exact step follows: vectors are dealt into
blocks and each pair of blocks is compared in tiles. In the block's principal axes a cosine is at most the product of the
first half of the axes plus the product of the norms of the rest; only pairs whose bound reaches the threshold are worked
out in double precision. This counts every vector's links and unites what the passes missed. Its work is quadratic: about
n * n / 2 products of half a vector (51,282 vectors of 64 numbers: under 10 core seconds; ten times the vectors, a hundred times
that), and each vector is sent to every block, 64 at most up to 4 million vectors.

Without `complete`, passes go on until they are measured to be enough: after each round of `passes` passes, `probes` vectors
drawn by hash (others each round) are compared with all vectors, and while fewer than `recall` of their links (as a mean
over the probes that have any) are within one component, another round follows, with twice the window and, in every other
pass, planes through drawn vectors, which also split a dense cone off the origin. What the probes show to be missed is
united as well. A round that would cost as much as comparing all pairs is replaced by the exact step, so the loop ends.
Links are then counted exactly within components.

Equal vectors form a class and take part once with their number. Sort keys end in the id, so a group of near copies spans
as many partitions as it needs; a task of an exact step holds two blocks.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; so do those without
an id. Vectors of different length are never compared. Rows that repeat an id are vectors of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import components, forest, stored


def _planes(dims: int, number: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, number, dims]).standard_normal((dims, bits))


def _units(column) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, padded with zeros to one width, and their true lengths."""
    dims = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(column), int(dims.max(initial=0))))
    out[np.arange(out.shape[1]) < dims[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True), dims


def _offsets(drawn: np.ndarray, dims: np.ndarray, d: int, planes: np.ndarray, number: int, seed: int) -> np.ndarray:
    """Where each plane cuts: through a drawn vector of that length, or through the origin if there is none."""
    own = drawn[dims == d]
    if not len(own):
        return np.zeros(planes.shape[1])
    at = np.random.default_rng([seed, number, d, 1]).integers(0, len(own), planes.shape[1])
    return np.einsum("bd,db->b", own[at][:, :d], planes)


def _keys(numbers: list[int], bits: int, seed: int, drawn: tuple[np.ndarray, np.ndarray] | None = None):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                units, dims = _units(part["v"])
                for number in numbers:
                    key = np.zeros(len(units), np.int64)
                    for d in np.unique(dims).tolist():
                        at = dims == d
                        planes = _planes(d, number, bits, seed)
                        cut = _offsets(*drawn, d, planes, number, seed) if drawn is not None and number % 2 else 0
                        key[at] = (units[at, :d] @ planes > cut) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(units), number, np.int32)), pa.array(dims.astype(np.int32)), pa.array(key), part["id"], part["v"]], ["pass", "dims", "key", "id", "v"])

    return run


def _windows(threshold: float, window: int):
    """A spanning forest of what neighbours in a sorted partition link."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pairs, held = [], None
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                units, dims = _units(part["v"])
                own = part["id"].to_numpy()
                tag = part["pass"].to_numpy().astype(np.int64) << 32 | dims
                if held is not None:
                    width = max(units.shape[1], held[0].shape[1])
                    units = np.vstack([np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (held[0], units)])
                    own, tag = np.concatenate((held[1], own)), np.concatenate((held[2], tag))
                first = len(own) - part.num_rows
                near = units[first:] @ units.T >= threshold
                gap = np.arange(first, len(own))[:, None] - np.arange(len(own))
                near &= (gap > 0) & (gap <= window) & (tag[first:, None] == tag)
                for x, y in np.argwhere(near).tolist():
                    pairs.append((int(own[first + x]), int(own[y])))
                if len(pairs) > 200_000:
                    pairs = forest(pairs)
                held = units[-window:], own[-window:], tag[-window:]
        pairs = forest(pairs)
        for i in range(0, len(pairs), 50_000):
            some = pairs[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in some], pa.int64()), pa.array([p[1] for p in some], pa.int64())], ["a", "b"])

    return run


def _block_links(threshold: float, tile: int):
    """Of the vectors of two blocks (or of one): each one's links to those of the other side, then a spanning forest of the
    links between components. table: (id, v, many, c, b)."""

    def run(table):
        import pyarrow as pa

        table = table.sort_by("b")
        units, dims = _units(table["v"].combine_chunks())
        side, own, comp, many = (table[c].to_numpy() for c in ("b", "id", "c", "many"))
        axes = np.linalg.eigh(units.T @ units)[1][:, ::-1]
        turned, half = units @ axes, -(-units.shape[1] // 2)
        head, rest = turned[:, :half].astype(np.float32), np.linalg.norm(turned[:, half:], axis=1).astype(np.float32)
        del turned
        cut = int(np.searchsorted(side, side[0], "right"))
        one = cut == len(side)
        links, pairs = np.zeros(len(side), np.int64), []
        for x in range(0, cut, tile):
            xs = slice(x, min(x + tile, cut))
            for y in range(x if one else cut, len(side), tile):
                ys = slice(y, min(y + tile, len(side)))
                # the margin is far above what single precision loses
                near = head[xs] @ head[ys].T + rest[xs, None] * rest[ys] >= threshold - 1e-4
                if x == y:
                    near = np.triu(near, 1)
                number = np.count_nonzero(near)
                if number > near.size // 50:
                    near &= (units[xs] @ units[ys].T >= threshold) & (dims[xs, None] == dims[ys])
                    a, b = np.nonzero(near)
                elif number:
                    a, b = np.nonzero(near)
                    good = (np.einsum("ij,ij->i", units[x + a], units[y + b]) >= threshold) & (dims[x + a] == dims[y + b])
                    a, b = a[good], b[good]
                else:
                    continue
                a, b = a + x, b + y
                links += np.bincount(a, many[b], len(side)).astype(np.int64) + np.bincount(b, many[a], len(side)).astype(np.int64)
                new = comp[a] != comp[b]
                if new.any():
                    pairs += map(tuple, np.unique(np.stack((comp[a[new]], comp[b[new]]), axis=1), axis=0).tolist())
                if len(pairs) > 200_000:
                    pairs = forest(pairs)
        pairs, some = forest(pairs), np.flatnonzero(links)
        none = lambda n: pa.nulls(n, pa.int64())
        told = pa.table({"id": pa.array(own[some]), "links": pa.array(links[some]), "a": none(len(some)), "b": none(len(some))})
        more = pa.table({"id": none(len(pairs)), "links": none(len(pairs)), "a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})
        return pa.concat_tables([told, more])

    return run


def _prober(units: np.ndarray, dims: np.ndarray, nodes: np.ndarray, comps: np.ndarray, threshold: float):
    """Per task and probe: its links to other vectors and how many of them are within its component; then missed links."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        links, found, missed = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64), []
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                x, d = _units(part["v"])
                own, comp = part["id"].to_numpy(), part["component"].to_numpy()
                width = max(x.shape[1], units.shape[1])
                a, b = (np.pad(y, ((0, 0), (0, width - y.shape[1]))) for y in (x, units))
                near = (a @ b.T >= threshold) & (d[:, None] == dims) & (own[:, None] != nodes)
                same = comp[:, None] == comps
                links += near.sum(axis=0)
                found += (near & same).sum(axis=0)
                r, q = np.nonzero(near & ~same)
                if len(r):  # components stand for their members
                    missed += map(tuple, np.unique(np.stack((comps[q], comp[r]), axis=1), axis=0).tolist())
                if len(missed) > 200_000:
                    missed = forest(missed)
        missed = forest(missed)
        some = np.flatnonzero(links)
        none = lambda n: pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), none(len(some)), pa.array(links[some]), pa.array(found[some])], ["a", "b", "links", "found"])
        for i in range(0, len(missed), 50_000):
            m = missed[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in m], pa.int64()), pa.array([p[1] for p in m], pa.int64()), none(len(m)), none(len(m))], ["a", "b", "links", "found"])

    return run


def _dealt(members: DataFrame) -> DataFrame:
    """Each vector once for every pair (i, j) of blocks that its own block `b` of `blocks` is in."""
    names = [c for c in members.columns if c != "blocks"]
    return members.select(*names, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x")).select(*names, F.least("b", "x").alias("i"), F.greatest("b", "x").alias("j"))


def _drawn(placed: DataFrame, probes: int, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors, lengths, nodes and components of the probes of a round."""
    import pyarrow as pa

    got = placed.orderBy(F.xxhash64("id", F.lit(number)), "id").limit(probes).collect()
    units, dims = _units(pa.array([r.v for r in got], pa.list_(pa.float64())))
    return units, dims, np.array([r.id for r in got], np.int64), np.array([r.component for r in got], np.int64)


def _compared(members: DataFrame, *, threshold: float, tile: int) -> DataFrame:
    """(id, links) and (a, b), links between components, for members (id, v, many, c, b, blocks) of blocks that all meet."""
    return stored(_dealt(members).groupBy("i", "j").applyInArrow(_block_links(threshold, tile), "id long, links long, a long, b long"), "vector-links")


def _dealt_all(classes: DataFrame, comp: DataFrame | None, block: int) -> DataFrame:
    """All classes in blocks by hash: of `block` vectors, or so many more that there are 64 blocks, up to 65,536 a block."""
    total = classes.count()
    blocks = max(1, -(-total // min(65_536, max(block, -(-total // 64)))))
    placed = classes.withColumn("c", F.col("node")) if comp is None else classes.join(comp.select("node", F.col("component").alias("c")), "node", "left")
    return placed.select(F.col("node").alias("id"), "v", "many", F.coalesce("c", "node").alias("c"), F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("b"), F.lit(blocks).alias("blocks"))


def _passes(classes: DataFrame, kind: str, numbers: list[int], edges: DataFrame | None, drawn, *, threshold: float, at_once: int, bits: int, window: int, seed: int) -> DataFrame:
    """edges and what the passes of these numbers link."""
    for first in range(0, len(numbers), at_once):
        keyed = classes.select(F.col("node").alias("id"), "v").mapInArrow(_keys(numbers[first : first + at_once], bits, seed, drawn), f"pass int, dims int, key long, id long, v {kind}")
        found = stored(keyed.repartitionByRange("pass", "dims", "key", "id").sortWithinPartitions("pass", "dims", "key", "id").mapInArrow(_windows(threshold, window), "a long, b long"), "vector-links")
        edges = found if edges is None else edges.unionByName(found)
    return edges


def _measured(classes: DataFrame, kind: str, *, threshold: float, passes: int, at_once: int, bits: int, window: int, block: int, tile: int, seed: int, recall: float, probes: int) -> DataFrame:
    """(node, component) for every vector of classes (node, v, many) with a link found; goes on until the measured recall is met."""
    total, drawn, edges, number = classes.count(), None, None, 0
    while True:
        if number > 0 and 2 * passes * window >= total:
            found = _compared(_dealt_all(classes, None, block), threshold=threshold, tile=tile)
            return stored(components(found.where("a is not null").select("a", "b").unionByName(edges), "vector-components"), "vector-members")
        edges = _passes(classes, kind, [number * passes + k for k in range(passes)], edges, drawn, threshold=threshold, at_once=at_once, bits=bits, window=window, seed=seed)
        comp = stored(components(edges, "vector-components"), "vector-members")
        if not total:
            return comp
        placed = stored(classes.join(comp, "node", "left").select(F.col("node").alias("id"), "v", F.coalesce("component", "node").alias("component")), "vector-placed")
        probe = _drawn(placed, probes, number)
        seen = stored(placed.mapInArrow(_prober(*probe, threshold), "a long, b long, links long, found long"), "vector-probes")
        reached = seen.where("links is not null").groupBy("a").agg((F.sum("found") / F.sum("links")).alias("share")).agg(F.avg("share")).first()[0]
        missed = seen.where("b is not null").select("a", "b")
        edges = comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(missed)
        if reached is None or reached >= recall:
            return comp if reached in (None, 1.0) else stored(components(edges, "vector-components"), "vector-members")
        drawn, number, window = probe[:2], number + 1, 2 * window


def near_vectors(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, complete: bool = True, passes: int = 8, at_once: int = 8, bits: int = 62, window: int = 64, block: int = 8192, tile: int = 1024, seed: int = 1, recall: float = 0.99, probes: int = 4096) -> DataFrame:
    """vectors with `n_links`, `component_id` and `kept` added (columns of these names are replaced)."""
    names = [c for c in vectors.columns if c not in ("n_links", "component_id", "kept")]
    # single precision is carried as it is, which loses nothing and takes half the room; cosines are of doubles
    kind = "array<float>" if dict(vectors.dtypes)[vector] == "array<float>" else "array<double>"
    v = F.col(f"`{vector}`").cast(kind)
    sound = F.col(f"`{key}`").isNotNull() & F.coalesce(F.size(v) > 0, F.lit(False)) & ~F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), F.col(f"`{key}`").cast("long").alias("id"), F.when(sound, v).alias("v"))
    rows = rows.withColumn("h1", F.when(F.col("v").isNotNull(), F.xxhash64("v"))).withColumn("h2", F.when(F.col("v").isNotNull(), F.xxhash64(F.lit("second"), "v")))
    good = rows.where(F.col("v").isNotNull())
    classes = good.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("many"))
    # one vector of a class: the row of the least id; repeated rows of it are equal. An id that several different vectors
    # carry stands for the class of each: number classes apart from ids
    classes = good.join(classes, ["h1", "h2", "id"]).groupBy("h1", "h2", "id", "many").agg(F.any_value("v").alias("v"))
    classes = stored(classes.withColumn("node", F.xxhash64("h1", "h2")), "vector-classes")
    own = classes.select("node", "v", "many")
    common = {"threshold": threshold, "at_once": at_once, "bits": bits, "window": window, "seed": seed}
    if complete:
        comp = components(_passes(own, kind, list(range(passes)), None, None, **common), "vector-components")
        found = _compared(_dealt_all(own, comp, block), threshold=threshold, tile=tile)
        edges = comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found.where("a is not null").select("a", "b"))
        comp = components(edges, "vector-all")
    else:
        comp = _measured(own, kind, passes=passes, block=block, tile=tile, recall=recall, probes=probes, **common)
        sizes = comp.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        members = own.join(comp, "node").join(sizes, "component").select(F.col("node").alias("id"), "v", "many", F.col("component").alias("c"), F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("b"), "blocks")
        found = stored(_dealt(members).groupBy("c", "i", "j").applyInArrow(_block_links(threshold, tile), "id long, links long, a long, b long"), "vector-links")
    counted = found.where("id is not null").groupBy(F.col("id").alias("node")).agg(F.sum("links").alias("links"))
    ends = classes.select("h1", "h2", "node", "id", "many").join(comp, "node", "left").join(counted, "node", "left").select("h1", "h2", "id", "many", F.coalesce("component", "node").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    ends = ends.join(ends.groupBy("component").agg(F.min("id").alias("component_id")), "component").select("h1", "h2", "component_id", (F.col("links") + F.col("many") - 1).alias("n_links"))
    some = good.join(ends, ["h1", "h2"]).select("_row.*", "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    rest = rows.where(F.col("v").isNull()).select("_row.*", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return some.unionByName(rest)
