"""Jaccard self-join on word n-grams with filters under several global token orders.

A text's set holds its distinct `n`-word shingles. Texts with equal sets form a class, known by a hash of the set; a class
takes part once. Two sets of Jaccard similarity t share a token among the first |x| - ceil(t |x|) + 1 of either under any
one order of all tokens, so candidates must do so under each of several orders:

1. Rarest first, over the corpus. In small sets all tokens, in larger ones a half or a quarter (by hash) come first, by
   document frequency; the rest follows by hash, which a prefix seldom reaches. A token that one document has joins
   nothing, so most texts are left without a token here and are done. Candidates share a token's bucket and are of like size.
2. Candidate pairs of class ids must then share prefix tokens under the next orders, two by independent hashes and one that
   is rarest first where they meet. The filters are intersected, with that of set sizes, before the sets of a pair are
   intersected and the link is decided exactly on 64-bit shingle hashes.

Buckets are not expanded into all pairs. First each meets one member of its own, the pivot, in `rounds` rounds with other
pivots, and what these pairs link makes groups: a bucket whose members are all in one group is done. Of what is left, buckets
of at most `few` members give the pairs of members of different groups, as ids; larger ones give pairs of blocks, each
once however many buckets two blocks share. Sets are worked out once for each class that shares a bucket and come together
where they are verified, in tasks of at most `block` sets a side, however hot a token or large a group is. A pair that is
connected already within its task is not verified again: a task returns a spanning forest, never all pairs.

What stays quadratic: m texts of like size whose rarest tokens are common to them all, although few of them are alike, take
(m / block)**2 / 2 tasks, each a matrix of candidates that the other orders thin out.

Edge cases: null, empty and blank texts have no shingles, link with nothing and are components of their own. Fewer words
than `n` make one shingle. Rows without an id take part like others (a component's id is its least non-null one). Repeated
rows are copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import Sets, components, lean, mix, pieces_of, small_batches, stored, text_buffer, text_of, trimmed, word_hashes

_SEEDS = [np.uint64(int(x)) for x in np.random.default_rng(7).integers(1, 2**63, 8)]


def shingle_sets(column, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; column: an Arrow string array without nulls."""
    data, at = text_buffer(column)
    words, first = word_hashes(data, at[:-1])
    ends = np.searchsorted(first, at)
    rolled = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        rolled += words[k : k + len(rolled)] * (_SEEDS[k % 8] * np.uint64(2) + np.uint64(2 * (k // 8) + 1))
    rolled = mix(rolled)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:
            out.append(mix(np.array([sum((int(w) * int(_SEEDS[k]) for k, w in enumerate(words[a:b])), b - a) % 2**64], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _class(tokens: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(_signed(mix(mix(tokens ^ _SEEDS[6]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(tokens))))[0])


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


#: Set sizes from which one token in 2, then in 4 goes first. Sets on both sides of a border belong to both ranges as far as
#: they can be similar, so that every pair meets within one range and thus under one order.
_BORDERS = (60, 250)


def ranges(percent: int) -> list[tuple[int, float, int]]:
    """(least size, size above, share): one token in `share` goes first."""
    ups = [*_BORDERS, float("inf")]
    return [(percent * ups[k - 1] // 100 if k else 0, up, 2**k) for k, up in enumerate(ups)]


def _told(n: int, percent: int):
    """Per row: id, set size, class, and for a class that is new here, in each of its (one or two) ranges: how many of its
    tokens go first, and these with what else its prefix reaches."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: set[int] = set()
        for batch in batches:
            for part in pieces_of(batch, 1):
                cols: list[list] = [[] for _ in range(6)]
                for s in shingle_sets(part.column(1), n):
                    h, own = _class(s) if len(s) else None, []
                    if h is not None and h not in seen:
                        seen.add(h)
                        for k, (low, up, share) in enumerate(ranges(percent)):
                            if low <= len(s) < up:
                                early = s % np.uint64(share) == 0
                                first = s[early]
                                more = s[~early][: max(0, prefix_length(len(s), percent) - len(first))]
                                own += [len(first), _signed(mix(np.concatenate((first, more)) + _SEEDS[k]))]
                    for col, x in zip(cols, (len(s), h, *own, *[None] * (4 - len(own))), strict=True):
                        col.append(x)
                if len(seen) > 1_000_000:
                    seen.clear()  # a class that comes again is told twice, which later steps allow
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *map(pa.array, cols, kinds)], ["id", "x", "n", "h", "own0", "tokens0", "own1", "tokens1"])

    return run


def _filtered(prefixes: list[np.ndarray]) -> np.ndarray:
    """Which pairs share a prefix token."""
    m = len(prefixes)
    who, what = np.repeat(np.arange(m), [len(p) for p in prefixes]), np.concatenate(prefixes)
    order = np.argsort(what, kind="stable")
    who, what = who[order], what[order]
    cut = np.flatnonzero(np.concatenate(([True], what[1:] != what[:-1], [True])))
    out = np.zeros((m, m), bool)
    for k in np.flatnonzero(np.diff(cut) > 1):
        at = who[cut[k] : cut[k + 1]]
        out[at[:, None], at] = True
    return out


def links(sets: list[np.ndarray], ok: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the candidates: ok[a, b], a > b."""
    sizes = np.array([len(s) for s in sets])
    ok = ok & (100 * np.minimum(sizes[:, None], sizes) >= percent * np.maximum(sizes[:, None], sizes))
    tokens, back, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    ends = np.cumsum(sizes)
    lengths = [prefix_length(n, percent) for n in sizes.tolist()]
    for order in (mix(tokens ^ _SEEDS[4]), mix(tokens ^ _SEEDS[5]), np.argsort(np.argsort(count, kind="stable"))):
        if not ok.any():
            return []
        ranks = order[back]
        ok &= _filtered([np.sort(ranks[b - n : b])[:p] for b, n, p in zip(ends.tolist(), sizes.tolist(), lengths, strict=True)])
    found, out = Sets(len(sets)), []
    if ok.sum() > 4096 and len(sets) * len(tokens) <= 1 << 24:
        # many candidates among few tokens: all intersections at once, exact in single precision
        holds = np.zeros((len(sets), len(tokens)), np.float32)
        holds[np.repeat(np.arange(len(sets)), sizes), back] = 1
        same = (holds @ holds.T).astype(np.int64)
        ok &= 100 * same >= percent * (sizes[:, None] + sizes - same)
        return [(a, b) for a, b in np.argwhere(ok).tolist() if found.join(a, b)]
    for a, b in np.argwhere(ok).tolist():
        if found.find(a) != found.find(b):
            x, y = (sets[a], sets[b]) if len(sets[a]) <= len(sets[b]) else (sets[b], sets[a])
            at = np.searchsorted(y, x)
            same = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            if 100 * same >= percent * (len(x) + len(y) - same):
                found.join(a, b)
                out.append((a, b))
    return out


def _sets_of(n: int):
    """(h, s) for texts with the class that they are looked up for, each class once a task."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        done: set[int] = set()
        for batch in batches:
            for part in pieces_of(batch, 0):
                h, sets = [], []
                for own, s in zip(part.column(1).to_pylist(), shingle_sets(part.column(0), n), strict=True):
                    if own not in done and len(s) and _class(s) == own:
                        done.add(own)
                        h.append(own)
                        sets.append(_signed(s))
                if len(done) > 1_000_000:
                    done.clear()
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["h", "s"])

    return run


def _held(table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Classes in order, the first row of each, and their sets; table: (h, s)."""
    h, first = np.unique(table["h"].to_numpy(), return_index=True)
    lists = table["s"].combine_chunks()
    at, flat = np.asarray(lists.offsets), lists.values.to_numpy().view(np.uint64)
    return h, first, [flat[at[k] : at[k + 1]] for k in first.tolist()]


def _told_links(h: np.ndarray, sets: list[np.ndarray], ok: np.ndarray, percent: int):
    import pyarrow as pa

    got = np.array(links(sets, ok, percent), np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(h[got[:, 0]], pa.int64()), "b": pa.array(h[got[:, 1]], pa.int64())})


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links among pairs (a, b, g, i, j), as a spanning forest of each group (g, i, j)."""

    def run(pairs, held):
        h, _, own = _held(held)
        a, b = (np.searchsorted(h, pairs[c].to_numpy()) for c in "ab")
        ok = np.zeros((len(h), len(h)), bool)
        ok[np.maximum(a, b), np.minimum(a, b)] = True
        return _told_links(h, own, ok, percent)

    key = [F.col(c).alias(c + c) for c in "gij"]
    needed = pairs.select(*key, F.col("a").alias("h")).union(pairs.select(*key, F.col("b").alias("h"))).distinct().join(sets, "h")
    return stored(pairs.groupBy("g", "i", "j").cogroup(needed.groupBy("gg", "ii", "jj")).applyInArrow(run, "a long, b long"), "ngram-links")


def _dense(live: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """The links among members (h, token, c) of large buckets that are in different groups.

    Classes are dealt into blocks by the largest of their buckets, and two blocks meet once if any bucket has members in both.
    """
    sizes = live.groupBy("token").agg(F.count("*").alias("df"))
    home = live.join(sizes, "token").groupBy("h").agg(F.max(F.struct("df", "token")).alias("top"), F.first("c").alias("c")).select("h", "c", F.col("top.token").alias("top"))
    slots = home.groupBy("top").agg(F.ceil(F.count("*") / block).alias("slots"))
    home = stored(home.join(slots, "top").select("h", "c", F.xxhash64("top", F.pmod(F.xxhash64("h"), "slots")).alias("block")), "ngram-home")
    spread = stored(live.join(home, "h").select("token", "block").distinct(), "ngram-spread")
    meet = _beside(spread.select("token", F.col("block").alias("i")), spread.select("token", F.col("block").alias("j")), "token", 4096).where("i <= j").select("i", "j").distinct()
    sides = meet.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))

    def run(table):
        h, first, own = _held(table)
        c, side = (table[x].to_numpy()[first] for x in ("c", "block"))
        ok = np.tri(len(h), k=-1, dtype=bool) & (c[:, None] != c)
        if side.min() != side.max():
            ok &= side[:, None] != side
        return _told_links(h, own, ok, percent)

    return stored(sides.join(home, "block").join(sets, "h").groupBy("i", "j").applyInArrow(run, "a long, b long"), "ngram-links")


def _beside(many: DataFrame, one: DataFrame, key: str, slot: int) -> DataFrame:
    """many joined with one on key; a key of more than `slot` rows in many is dealt over as many tasks as it needs."""
    heavy = stored(many.groupBy(key).agg(F.ceil(F.count("*") / slot).cast("int").alias("_slots")).where("_slots > 1"), "ngram-heavy")
    if heavy.isEmpty():
        return many.join(one, key)
    names = [c for c in many.columns if c != key]
    dealt = many.join(lean(heavy, 1_000_000), key, "left").withColumn("_slot", F.pmod(F.xxhash64(*names), F.coalesce("_slots", F.lit(1))).cast("int")).drop("_slots")
    copied = one.join(lean(heavy, 1_000_000), key, "left").withColumn("_slot", F.explode(F.sequence(F.lit(0), F.coalesce("_slots", F.lit(1)) - 1))).drop("_slots")
    return dealt.join(copied, [key, "_slot"]).drop("_slot")


def _grouped(members: DataFrame, links: DataFrame | None) -> DataFrame:
    """members (h, token, n) of buckets with several groups, with the group c of each."""
    if links is None:
        return members.withColumn("c", F.col("h"))
    comp = components(links, "ngram-groups").select(F.col("node").alias("h"), F.col("component").alias("c"))
    placed = members.select("h", "token", "n").join(comp, "h", "left").select("h", "token", "n", F.coalesce("c", "h").alias("c"))
    mixed = placed.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("token")
    return stored(placed.join(mixed, "token", "left_semi"), "ngram-mixed")


def jaccard_classes(docs: DataFrame, *, n: int = 5, percent: int = 80, doc: str = "doc_id", text: str = "text", block: int = 256, few: int = 32, rounds: int = 3, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(id, n_shingles, component_id, x, component) for each row of docs: component_id is the least id that links of at least
    percent/100 reach, x the text's xxhash64, component the group itself (null without shingles)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc).cast("long").alias("id"), text_of(text).alias("text")).withColumn("x", F.xxhash64("text"))
    told = stored(rows.mapInArrow(trimmed(_told(n, percent)), "id long, x long, n long, h long, own0 long, tokens0 array<long>, own1 long, tokens1 array<long>"), "ngram-tokens")
    signed = told.select("id", "x", "n", "h")
    classes = stored(signed.where(F.col("h").isNotNull()).groupBy("h").agg(F.min("id").alias("least"), F.min("x").alias("x"), F.first("n").alias("n")), "ngram-classes")

    # rarest first: what one document has is dropped from its prefix, which most texts lose whole
    range_of = lambda k: told.where(F.col(f"own{k}").isNotNull()).select("h", F.lit(k).alias("r"), "n", F.col(f"own{k}").alias("own"), F.col(f"tokens{k}").alias("tokens"))
    both = range_of(0).unionByName(range_of(1))
    posts = both.select("h", "r", F.explode("tokens").alias("token"))
    common = posts.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = posts.join(common, "token").groupBy("h", "r").agg(F.sort_array(F.collect_set(F.struct("df", "token"))).alias("t"))
    sizes = both.groupBy("h", "r").agg(F.first("n").alias("n"), F.first("own").alias("own"))
    p = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1
    left = F.when(F.col("own") >= p, p - (F.col("own") - F.size("t"))).otherwise(F.size("t"))
    # sets that can be similar are of one or of neighbouring bands of size
    band = F.floor(F.log(F.col("n")) / (math.log(100 / percent) + 1e-6))
    prefix = shared.join(sizes, ["h", "r"]).where(left > 0).select("h", "n", F.explode(F.transform(F.slice("t", 1, left.cast("int")), lambda x: x["token"])).alias("token"), band.alias("band"))
    prefix = stored(prefix.select("h", "n", F.explode(F.array(F.xxhash64("token", "band"), F.xxhash64("token", F.col("band") - 1))).alias("token")), "ngram-prefixes")
    buckets = prefix.groupBy("token").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("token")
    members = stored(_beside(prefix, buckets, "token", 1 << 16).select("h", "token", "n"), "ngram-members")

    # the sets of classes that share a bucket
    chosen = stored(members.select("h").distinct().join(classes, "h").select("x", "h"), "ngram-chosen")
    sets = stored(rows.select("text", "x").join(lean(chosen, broadcast_rows), "x").select("text", "h").mapInArrow(trimmed(_sets_of(n)), "h long, s array<long>").dropDuplicates(["h"]), "ngram-sets")

    alike = lambda a, b: F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)
    both_of = lambda x, y: y if x is None else x.unionByName(y)
    found, live = None, members
    for k in range(rounds):
        live = _grouped(live, found)
        if live.isEmpty():
            break
        rank = F.xxhash64("h", F.lit(k))
        pivots = live.groupBy("token").agg(F.min_by(F.struct(F.col("h").alias("a"), F.col("n").alias("m"), F.col("c").alias("d")), rank).alias("p")).select("token", "p.*")
        stars = _beside(live, pivots, "token", 1 << 16).where((F.col("c") != F.col("d")) & alike(F.col("n"), F.col("m"))).select("a", F.col("h").alias("b")).distinct()
        stars = stored(stars, "ngram-stars")
        slots = stars.groupBy("a").agg(F.ceil(F.count("*") / block).cast("int").alias("slots"))
        dealt = stars.join(slots, "a").select("a", "b", F.col("a").alias("g"), F.lit(0).alias("i"), F.pmod(F.xxhash64("b"), "slots").cast("int").alias("j"))
        found = both_of(found, _verified(dealt, sets, percent))
    else:
        live = _grouped(live, found)
    if not live.isEmpty():
        large = stored(live.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") > few).select("token"), "ngram-large")
        if not large.isEmpty():
            found = both_of(found, _dense(live.join(large, "token", "left_semi"), sets, percent, block))
            live = stored(live.join(large, "token", "left_anti"), "ngram-small")
        x, y = (live.select("token", *(F.col(c).alias(s + c) for c in ("h", "n", "c"))) for s in "xy")
        pairs = x.join(y, "token").where((F.col("xh") < F.col("yh")) & (F.col("xc") != F.col("yc")) & alike(F.col("xn"), F.col("yn"))).select(F.col("xh").alias("a"), F.col("yh").alias("b")).distinct()
        pairs = stored(pairs, "ngram-pairs")
        # sets that meet in many pairs come together once for a block of them
        group = components(pairs, "ngram-near")
        many = group.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        at = stored(group.join(many, "component").select(F.col("node").alias("h"), F.col("component").alias("g"), F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("k")), "ngram-blocks")
        placed = pairs.join(at.select(F.col("h").alias("a"), "g", F.col("k").alias("i")), "a").join(at.select(F.col("h").alias("b"), F.col("k").alias("j")), "b")
        found = both_of(found, _verified(placed.select("a", "b", "g", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")), sets, percent))

    if found is None:
        ends = classes.select("h", F.col("h").alias("component"), F.col("least").alias("component_id"))
    else:
        linked = components(found, "ngram-links").select(F.col("node").alias("h"), "component")
        ends = classes.join(linked, "h", "left").select("h", "least", F.coalesce("component", "h").alias("component"))
        ends = ends.join(ends.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("h", "component", "component_id")
    return signed.join(ends, "h", "left").select("id", F.col("n").alias("n_shingles"), F.when(F.col("h").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"), "x", "component")
