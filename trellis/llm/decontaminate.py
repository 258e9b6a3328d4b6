"""Benchmark decontamination with one Aho-Corasick automaton.

Test questions and answers are normalised to words and cut into windows of `window` consecutive words; all windows go
into one automaton. Every distinct word of the benchmark is written with two or three letters, those of each place out of 64 of
its own, so no node has many children, a window is a short path and can only match from word to word. Each document is
normalised alike, its words are looked up (any other word is written with letters that no window has) and it is scanned once;
hits are places of words, and from there code-point spans of the original text.

Memory: an automaton is built from windows that begin at about `block_words` words of the benchmark, so it has at most three
times `window` times as many nodes (of some 100 bytes). Items are cut into pieces that overlap by a window less a word, and the
pieces of a larger benchmark are dealt into as many blocks as it takes by a hash, checked before anything is collected; the
documents are scanned once a block and the hits so far are carried along in a written table. So neither driver nor executors
ever hold more than a block. Documents are never shuffled, so no source or copied text can become a hot key.

Edge cases: null or wordless documents have n_words = n_hit = 0 and no items. Null or wordless items have no window. An
item without an id still marks words but is not listed. Repeated documents and items give repeated rows and one listing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import small_batches, stored, text_of, trimmed

#: Bytes to words: A-Z lowered, other ASCII besides letters and digits is a gap, all else belongs to words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = re.compile(_WORDS)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BUILT: dict[str, object] = {}


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


class Signs(dict):
    """How each of some words is written, `width` letters a word; other words are written with blanks."""

    def __init__(self, words: list[bytes]):
        self.width = 1
        while 64**self.width < len(words):
            self.width += 1
        self.blank = "\0" * self.width
        super().__init__((w, "".join(chr(64 * (k + 1) + n // 64**k % 64) for k in range(self.width))) for n, w in enumerate(words))

    def written(self, words: list[bytes]) -> str:
        return "".join([self.get(w, self.blank) for w in words])


def automaton(items: list[tuple[str | None, str | None]], window: int):
    """(automaton, signs) of all windows; a window's value is its length in words and the ids of its items."""
    import ahocorasick

    lists = [(item, words_of(text)) for item, text in items]
    signs = Signs(list(dict.fromkeys(w for _, x in lists for w in x)))
    owners: dict[str, set[str]] = {}
    for item, w in lists:
        line = signs.written(w)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            owners.setdefault(line[i * signs.width : (i + window) * signs.width], set()).update([item] if item is not None else [])
    if not owners:
        return None, signs
    auto = ahocorasick.Automaton()
    for k, ids in owners.items():
        auto.add_word(k, (len(k) // signs.width, frozenset(ids)))
    auto.make_automaton()
    return auto, signs


def find(auto, signs: Signs, text: str | None) -> tuple[int, list[int], set[str]]:
    """Number of words, runs of hit words as a flat list of first and end, ids of items found."""
    w = words_of(text)
    runs, ids = [], set()
    if auto is not None and w:
        for end, (k, owners) in auto.iter(signs.written(w)):
            last = (end + 1) // signs.width
            runs.append((last - k, last))
            ids |= owners
    return len(w), merged(runs), ids


def merged(runs: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(runs):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _scanner(items, window: int, key: str, last: bool):
    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = automaton(items.value, window)
        auto, signs = _BUILT[key]
        for batch in batches:
            n, hit, found, spans = [], [], [], []
            for text, old, ids in zip(batch["_text"].to_pylist(), batch["_hit"].to_pylist(), batch["_items"].to_pylist(), strict=True):
                count, runs, more = find(auto, signs, text)
                if old:
                    runs = merged([*zip(old[::2], old[1::2], strict=True), *zip(runs[::2], runs[1::2], strict=True)])
                n.append(count)
                hit.append(runs)
                found.append(sorted(more | set(ids)))
                at = [m.span() for m in _WORD.finditer(text)] if runs and last else []
                spans.append([{"start": at[a][0], "end": at[b - 1][1]} for a, b in zip(runs[::2], runs[1::2], strict=True)] if last else [])
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in batch.schema.names if c not in ("_n", "_hit", "_items", "_spans")), pa.array(n, pa.int64()), pa.array(hit, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                [*(c for c in batch.schema.names if c not in ("_n", "_hit", "_items", "_spans")), "_n", "_hit", "_items", "_spans"],
            )

    return scan


def scan(docs: DataFrame, items: DataFrame, *, window: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text", block_words: int = 100_000) -> DataFrame:
    """docs with `n_words`, `n_hit`, `items` (ids as strings, sorted) and `spans` (code points of the original text) added.

    Columns of docs keep their places; one that has an added column's name is replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    words = F.regexp_extract_all(F.translate(F.col(item_text).cast("string"), _UPPER, _UPPER.lower()), F.lit(_WORDS), F.lit(0))
    items = items.select(F.col(item).cast("string").alias("i"), words.alias("w")).where(F.size("w") > 0)
    piece = min(block_words, 20_000)
    number = F.greatest(F.lit(1), F.ceil((F.size("w") - window + 1) / piece)).cast("int")
    items = items.select("i", "w", F.explode(F.sequence(F.lit(0), number - 1)).alias("k")).select("i", F.slice("w", F.col("k") * piece + 1, F.lit(piece + window - 1)).alias("w"))
    items = items.select("i", F.size("w").alias("n"), F.array_join("w", " ").alias("t"))
    total = items.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    blocks = -(-total // block_words) or 1
    names = [c for c in docs.columns if c not in ("n_words", "n_hit", "items", "spans")]
    df = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), text_of(text).alias("_text"), F.lit(0).cast("long").alias("_n"), F.array().cast("array<int>").alias("_hit"), F.array().cast("array<string>").alias("_items"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("_spans"))
    for k in range(blocks):
        own = [(r.i, r.t) for r in items.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == k).collect()]
        df = df.mapInArrow(trimmed(_scanner(sent := spark.sparkContext.broadcast(own), window, f"{spark.sparkContext.applicationId}/{sent._jbroadcast.id()}", k == blocks - 1)), df.schema)
        if k < blocks - 1:
            df = stored(df, "decontaminate")
    hit = F.aggregate(F.sequence(F.lit(0), (F.size("_hit") / 2).cast("int") - 1), F.lit(0).cast("long"), lambda s, i: s + F.col("_hit")[2 * i + 1] - F.col("_hit")[2 * i])
    return df.select("_row.*", F.col("_n").alias("n_words"), F.when(F.size("_hit") > 0, hit).otherwise(F.lit(0).cast("long")).alias("n_hit"), F.col("_items").alias("items"), F.col("_spans").alias("spans"))
