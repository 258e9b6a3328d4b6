"""Line dedup within an edit distance, with DataFrame functions only.

A line goes when the same line, or one within `edits` edits of it, comes earlier in the corpus (by document id, then
place). Lines of fewer than `least` characters go only as exact repeats: a few edits make any short line another.

Near lines are found by segment partition. Of two lines within t edits, one's t + 1 even segments cannot all be touched, so
one of them is a substring of the other. Every line indexes its segments under (its length, segment number, content) and
probes, for each length from its own down to t shorter, the substrings that a segment could equal: only start positions
within the shift that the segment's number and the two lengths allow (the multi-match-aware window). Keys are 64-bit
hashes. Candidates must, within that join, have like numbers of letters, and are then verified by banded bit-parallel edit distance: the 2t + 1 diagonals around the main one are the bits
of a word, and a character of the text moves all of them on with a dozen word operations.

Scale: only hashes, positions and keys are shuffled, never texts; equal lines are merged (by a partial aggregate) before
any key is made, so a line in a third of all documents has one set of keys. Candidates come from equi-joins whose hot keys
adaptive execution can split. Texts of candidate lines are fetched by position; what must be looked up meets the documents
by broadcast if a count shows it within `broadcast_rows`, and by a shuffle beyond.

Edge cases: null text is empty, empty lines stay. Documents without an id neither lose lines nor cost others theirs. Rows
that repeat an id with the same text are one document and keep the same lines; added columns replace those of their name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import smaller_than, stored, text_of


def edit_distance_within(df: DataFrame, a: str, b: str, t: int) -> DataFrame:
    """df with `_near`: whether the edit distance of columns a and b is at most t, by the banded bit-parallel recurrence.

    At character j of b, bit k of a word stands for row j - t + k of the pattern a. The distance is followed down the
    lowest diagonal of the band until that leaves the pattern, then along the pattern's last row; it cannot come back from
    more than `_most` on the diagonal, and then nothing more is worked out. Characters and the words that say where they
    match are columns of their own, so that each is made once and the recurrence carries four numbers.
    """
    width = 2 * t + 1
    full = (1 << width) - 1
    pad = F.array_repeat(F.lit(None).cast("string"), t)
    df = df.withColumns({"_p": F.concat(pad, F.split(a, "")), "_q": F.split(b, ""), "_m": F.length(a), "_n": F.length(b)})

    def match(c: Column, j: Column) -> Column:
        eq = F.lit(0)
        for k in range(width):
            eq = eq.bitwiseOR(F.when(F.get("_p", j + k) == c, 1 << k).otherwise(0))
        return eq

    df = df.withColumns({"_eq": F.transform("_q", match), "_most": F.col("_n") - F.col("_m") + 2 * t})

    def diagonals(s: Column, eq: Column) -> Column:
        d0 = (eq.bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"]).bitwiseOR(eq).bitwiseOR(s["vn"]).bitwiseAND(full)
        return F.struct(*(s[c].alias(c) for c in ("j", "vp", "vn", "score")), d0.alias("d0"))

    def across(x: Column) -> Column:
        hp = x["vn"].bitwiseOR(F.bitwise_not(x["d0"].bitwiseOR(x["vp"])).bitwiseAND(full))
        return F.struct(x["j"].alias("j"), x["d0"].alias("d0"), hp.alias("hp"), x["d0"].bitwiseAND(x["vp"]).alias("hn"), F.shiftright(x["d0"], 1).alias("down"), x["score"].alias("score"))

    def advance(x: Column) -> Column:
        low = F.when(x["d0"].bitwiseAND(1 << (width - 1)) == 0, 1).otherwise(0)
        last = F.call_function("shiftleft", F.lit(1), F.col("_m") - 1 - x["j"] + t)
        row = F.when(x["hp"].bitwiseAND(last) != 0, 1).when(x["hn"].bitwiseAND(last) != 0, -1).otherwise(0)
        return F.struct(
            (x["j"] + 1).alias("j"),
            x["hn"].bitwiseOR(F.bitwise_not(x["down"].bitwiseOR(x["hp"])).bitwiseAND(full)).alias("vp"),
            x["down"].bitwiseAND(x["hp"]).alias("vn"),
            (x["score"] + F.when(x["j"] + t < F.col("_m"), low).otherwise(row)).alias("score"),
        )

    # a lambda's argument stands for a value, an expression is worked out wherever it stands: bind each step's results
    bound = lambda value, f: F.get(F.transform(F.array(value), f), 0)
    start = F.struct(F.lit(0).alias("j"), F.lit(((1 << (t + 1)) - 1) << t).alias("vp"), F.lit(0).alias("vn"), F.least(F.lit(t), F.col("_m")).alias("score"))
    walked = F.aggregate("_eq", start, lambda s, eq: F.when(s["score"] > F.col("_most"), s).otherwise(bound(bound(diagonals(s, eq), across), advance)), lambda s: s["score"])
    far = F.abs(F.col("_m") - F.col("_n")) > t
    near = F.when(far, False).when((F.col("_m") == 0) | (F.col("_n") == 0), True).otherwise(walked <= t)
    return df.withColumn("_near", near).drop("_p", "_q", "_m", "_n", "_eq", "_most")


#: Letters whose numbers are compared before verification, four bits of a long for each; any fifteen would do.
_LETTERS = "natrsiohdlucmgb"


def letter_counts(line: Column) -> Column:
    """How often each of fifteen letters stands in a line, modulo 16, in one long."""
    out = F.lit(0).cast("long")
    for k, x in enumerate(_LETTERS):
        out = out.bitwiseOR(F.shiftleft(((F.col("_bytes") - F.octet_length(F.replace(line, F.lit(x)))) % 16).cast("long"), 4 * k))
    return out


def like_letters(a: str, b: str, t: int) -> Column:
    """A necessary condition on letter counts: an edit changes the numbers of letters by two at most in all."""
    total = F.lit(0).cast("long")
    for k in range(len(_LETTERS)):
        apart = F.abs(F.shiftrightunsigned(a, 4 * k).bitwiseAND(15) - F.shiftrightunsigned(b, 4 * k).bitwiseAND(15))
        total = total + F.least(apart, 16 - apart)
    return total <= 2 * t


def measured(lines: DataFrame, t: int) -> DataFrame:
    """lines with what keys are made of, each worked out once a line: length, letters, and how the line (and one that is
    up to t characters shorter) is cut into t + 1 even segments, the longer ones last."""
    lines = lines.withColumns({"_long": F.length("line"), "_bytes": F.octet_length("line")}).withColumn("letters", letter_counts(F.col("line")))
    return lines.withColumns({f"_{c}{d}": F.expr(f"cast((_long - {d}) {sign} {t + 1} as int)") for d in range(t + 1) for c, sign in (("base", "div"), ("rest", "%"))})


def _key(d: int, i: int, t: int, shift: int) -> Column:
    """The key of segment i of lines d shorter, taken `shift` characters later than it begins there."""
    base, rest = F.col(f"_base{d}"), F.col(f"_rest{d}")
    at = i * base + F.greatest(F.lit(0), rest - (t + 1 - i)) if i else F.lit(0)
    return F.xxhash64(F.col("_long") - d, F.lit(i), F.substr(F.col("line"), at + shift + 1, base + (rest >= t + 1 - i).cast("int")))


def probe_keys(t: int) -> Column:
    """The keys a line probes with; its own segments in place, which are what it is indexed under, are the first t + 1."""
    places = [(d, i, shift) for d in range(t + 1) for i in range(t + 1) for shift in range(max(-i, d - (t - i)), min(i, d + (t - i)) + 1)]
    return F.array(*(_key(d, i, t, shift) for d, i, shift in sorted(places, key=lambda x: (x[0] != 0 or x[2] != 0, x))))


def near_lines(lines: DataFrame, texts, *, edits: int) -> DataFrame:
    """(aid, au, ap, bid, bu, bp): pairs of different lines within `edits` edits.

    lines: (u, p, line); texts(at) fetches (id, u, p, line) of the lines at (u, p).
    """
    # written, as both sides of the join read them: texts are split, counted and cut once
    keyed = stored(measured(lines, edits).select("u", "p", "letters", probe_keys(edits).alias("keys")), "line-keys")
    index = keyed.select(F.explode(F.slice("keys", 1, edits + 1)).alias("k"), F.col("u").alias("au"), F.col("p").alias("ap"), F.col("letters").alias("al"))
    probe = keyed.select(F.explode("keys").alias("key"), F.col("u").alias("bu"), F.col("p").alias("bp"), F.col("letters").alias("bl"))
    apart = (F.col("au") != F.col("bu")) | (F.col("ap") != F.col("bp"))
    met = index.join(probe, (F.col("k") == F.col("key")) & apart & like_letters("al", "bl", edits))
    turned = F.struct(F.col("au"), F.col("ap")) > F.struct(F.col("bu"), F.col("bp"))
    pairs = met.select(*(F.when(turned, F.col(y + c)).otherwise(F.col(x + c)).alias(x + c) for x, y in ("ab", "ba") for c in "up"))
    pairs = stored(pairs.distinct(), "line-candidates")
    held = stored(texts(pairs.select(F.col("au").alias("u"), F.col("ap").alias("p")).union(pairs.select("bu", "bp")).distinct()), "line-texts")
    a, b = (held.select(*(F.col(c).alias(x + c) for c in ("u", "p", "id", "line"))) for x in "ab")
    both = pairs.join(a, ["au", "ap"]).join(b, ["bu", "bp"]).where("aline <> bline")
    # not a filter: one would be moved below, and take every column it rests on apart into expressions worked out per step
    return edit_distance_within(both, "aline", "bline", edits).select("aid", "au", "ap", "bid", "bu", "bp", F.explode(F.when(F.col("_near"), F.array(F.lit(1))))).drop("col")


def dedup_lines(docs: DataFrame, *, edits: int = 2, least: int = 20, doc: str = "doc_id", text: str = "text", broadcast_rows: int = 1_000_000) -> DataFrame:
    """docs with `kept_text`, `n_lines`, `n_exact` and `n_near` (lines dropped as equal or near to an earlier one) added.

    `least` is the length from which near lines count; equal ones count at every length but nought.
    """
    if least <= 2 * edits:
        raise ValueError("lines must be longer than twice the edits for segments to exist and windows to fit")
    names = [c for c in docs.columns if c not in ("kept_text", "n_lines", "n_exact", "n_near")]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), F.col(doc).cast("long").alias("id"), text_of(text).alias("text"))
    rows = rows.withColumn("u", F.when(F.col("id").isNotNull(), F.xxhash64("id", "text")))
    split = rows.where(F.col("u").isNotNull()).select("id", "u", F.split("text", "\n", -1).alias("lines"))
    lines = split.select("id", "u", F.posexplode("lines").alias("p", "line")).where("line <> ''")
    seen = stored(lines.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"), "id", "u", "p"), "line-seen")
    firsts = stored(seen.groupBy("h1", "h2").agg(F.min(F.struct("id", "u", "p")).alias("f")).select("h1", "h2", F.col("f.id").alias("fid"), F.col("f.u").alias("fu"), F.col("f.p").alias("fp")), "line-firsts")
    # by place, which is no hot key however often a line stands
    again = stored(seen.join(firsts.select(F.col("fu").alias("u"), F.col("fp").alias("p")), ["u", "p"], "left_anti").select("u", "p").distinct(), "line-again")
    once = lines.where(F.length("line") >= least).join(F.broadcast(again) if smaller_than(again, broadcast_rows) else again, ["u", "p"], "left_anti").select("id", "u", "p", "line")

    def texts(at: DataFrame) -> DataFrame:
        wanted = at.groupBy("u").agg(F.collect_list("p").alias("at"))
        return split.join(F.broadcast(wanted) if smaller_than(at, broadcast_rows) else wanted, "u").select("id", "u", F.explode("at").alias("p"), "lines").select("id", "u", "p", F.get("lines", F.col("p")).alias("line")).distinct()

    pairs = stored(near_lines(once, texts, edits=edits), "line-pairs")
    order = F.struct("aid", "au", "ap") < F.struct("bid", "bu", "bp")
    near = stored(pairs.select(F.when(order, F.col("bu")).otherwise(F.col("au")).alias("u"), F.when(order, F.col("bp")).otherwise(F.col("ap")).alias("p")).distinct(), "line-near")

    gone = again.select("u", "p", F.lit(0).alias("near")).union(near.select("u", "p", F.lit(1).alias("near")))
    drops = gone.groupBy("u").agg(F.collect_list("p").alias("gone"), F.sum("near").alias("n_near"))
    out = rows.join(F.broadcast(drops) if smaller_than(gone, broadcast_rows) else drops, "u", "left").withColumn("lines", F.split("text", "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.transform(left, lambda i: F.get("lines", i))
    return out.select(
        "_row.*",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone") - F.col("n_near"), F.lit(0)).cast("long").alias("n_exact"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )
