"""Chat formatting of reply trees, with DataFrame functions only.

Messages form trees (parent ids). Iterative self-joins that double their reach follow the pointers: after round k every
message knows its ancestor 2**k up and the scores summed on the way, so threads of n turns take log2(n) joins, not n. When
all have come to their root, branches of a tree are ranked by their paths' scores, and only then are the chosen leaves'
root-to-leaf paths enumerated, by the same pointers. Each chosen path becomes one conversation.

Template: `<|im_start|>ROLE\\nTEXT<|im_end|>\\n` a turn. A run of backslashes between `<` and `|` in a text gets one more
backslash, so no text can hold a control string; `unescape` takes it away again. In roles, backslash and newline are
escaped too. `loss_spans` are the code-point spans of the escaped assistant texts.

A conversation is one row of output, and no more than its own turns ever meet in a task. Edge cases: null text and role
are empty; turns tie-break by role and text; a repeated row of turns is a turn of its own; of messages that repeat a node of
their tree the least (by parent, role, text) counts; an empty table gives no rows; a message whose parent is missing is a
root, and so is the least message of a cycle of parents; the null key is a tree like any other, a message without a node
is none. Only the named columns are read; others are not in the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trellis.llm.common import running, stored

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\\\|", r"<$1|")


def escape_role(c: Column) -> Column:
    return escape(F.replace(F.replace(c, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def unescape_role(c: Column) -> Column:
    return F.replace(F.replace(unescape(c), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def threads(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Linear conversations as reply trees: (tree, node, parent, role, text, score); each turn replies to the one before."""
    w = W.partitionBy("tree").orderBy(F.col("at").asc_nulls_first(), "role", "text")
    rows = turns.select(F.col(conv).alias("tree"), F.col(turn).alias("at"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((role, "role"), (text, "text"))))
    return rows.select("tree", F.row_number().over(w).cast("long").alias("node"), "role", "text").select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _same(x: str, y: str) -> Column:
    return F.col(x).eqNullSafe(F.col(y))


def _cut(links: DataFrame, circling: DataFrame, rounds: int) -> DataFrame:
    """links without the parent of each cycle's least message. circling: (t, n) of the messages on cycles."""
    at = links.join(circling, _same("tree", "t") & (F.col("node") == F.col("n")), "left_semi").select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("parent").alias("to"), F.col("node").alias("least"))
    for _ in range(rounds):
        on = at.select(F.col("t").alias("t2"), F.col("n").alias("n2"), F.col("to").alias("to2"), F.col("least").alias("least2"))
        at = stored(at.join(on, _same("t", "t2") & (F.col("to") == F.col("n2"))).select("t", "n", F.col("to2").alias("to"), F.least("least", "least2").alias("least")), "chat-cycles")
    roots = at.where("n = least").select("t", "n", F.lit(True).alias("opens"))
    return stored(links.join(roots, _same("tree", "t") & (F.col("node") == F.col("n")), "left").select("tree", "node", F.when(F.col("opens").isNull(), F.col("parent")).alias("parent"), "score"), "chat-links")


def pointers(links: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Per round k (t, n, to, s): the ancestor 2**k up of each message that has one, and the scores on the way there; then
    (t, n, s) with the whole path's score for every message. Messages that have come to their root leave the rounds.

    links: (tree, node, parent, score), nodes once, parents that exist.
    """
    every = links.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("parent").alias("to"), F.col("score").alias("s"))
    most = links.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    levels, live, done = [], every.where("to is not null"), every.where("to is null")
    while not live.isEmpty():
        if 2 ** len(levels) > most:
            return pointers(_cut(links, live.select("t", F.col("to").alias("n")).distinct(), len(levels)))
        levels.append(live)
        on = live.unionByName(done).select(F.col("t").alias("t2"), F.col("n").alias("n2"), F.col("to").alias("to2"), F.col("s").alias("s2"))
        step = stored(live.join(on, _same("t", "t2") & (F.col("to") == F.col("n2"))).select("t", "n", F.col("to2").alias("to"), (F.col("s") + F.col("s2")).alias("s")), "chat-pointers")
        live, done = step.where("to is not null"), done.unionByName(step.where("to is null"))
    return levels, done


def paths(messages: DataFrame, best: int | None) -> DataFrame:
    """(tree, leaf, branch, score, node, up): the messages of the `best` paths of each tree (None: all), the leaf at up = 0."""
    known = messages.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.lit(True).alias("found"))
    links = messages.join(known, _same("tree", "t") & (F.col("parent") == F.col("n")), "left").select("tree", "node", F.when(F.col("found"), F.col("parent")).alias("parent"), F.coalesce("score", F.lit(0.0)).alias("score"))
    levels, totals = pointers(stored(links, "chat-links"))
    leaves = totals
    if levels:
        parents = levels[0].select(F.col("t").alias("t2"), F.col("to").alias("n2")).distinct()
        leaves = totals.join(parents, _same("t", "t2") & (F.col("n") == F.col("n2")), "left_anti")
    ranked = leaves.withColumn("branch", F.row_number().over(W.partitionBy("t").orderBy(F.desc("s"), "n")))
    if best is not None:
        ranked = ranked.where(F.col("branch") <= best)
    found = stored(ranked.select(F.col("t").alias("tree"), F.col("n").alias("leaf"), "branch", F.col("s").alias("score"), F.col("n").alias("node"), F.lit(0).cast("long").alias("up")), "chat-paths")
    for k, level in enumerate(levels):
        on = level.select("t", "n", "to")
        more = found.join(on, _same("tree", "t") & (F.col("node") == F.col("n"))).select("tree", "leaf", "branch", "score", F.col("to").alias("node"), (F.col("up") + 2**k).alias("up"))
        found = found.unionByName(stored(more, "chat-paths"))
    return found


def format_trees(messages: DataFrame, *, best: int | None = 1, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(tree, leaf, score, branch, n_turns, formatted, loss_spans) for the `best` root-to-leaf paths of each tree (None: all).

    messages: (tree, node, parent, role, text, score). A path's score is the sum of its messages' scores (null: 0); branches
    rank by it, then by leaf.
    """
    least = F.min(F.struct("parent", "role", "text", "score")).alias("m")
    messages = stored(messages.where("node is not null").select("tree", "node", "parent", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")), "score").groupBy("tree", "node").agg(least).select("tree", "node", "m.*"), "chat-messages")
    on = paths(messages.select("tree", "node", "parent", "score"), best)
    body = messages.select(F.col("tree").alias("t"), F.col("node").alias("n"), escape_role(F.col("role")).alias("role"), escape(F.col("text")).alias("text"), F.col("role").isin(*trained).alias("loss"))
    turns = on.join(body, _same("tree", "t") & (F.col("node") == F.col("n")))
    got = turns.groupBy("tree", "leaf", "branch", "score").agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("k"), "role", "text", "loss"))).alias("m"))
    head = lambda x: F.concat(F.lit(START), x["role"], F.lit("\n"))
    got = got.withColumn("ends", running(F.transform("m", lambda x: (F.length(head(x)) + F.length(x["text"]) + len(END)).cast("long"))))
    stop = lambda i: F.get("ends", i) - len(END)
    spans = F.transform("m", lambda x, i: F.when(x["loss"], F.struct((stop(i) - F.length(x["text"])).alias("start"), stop(i).alias("end"))))
    return got.select("tree", "leaf", "score", "branch", F.size("m").cast("long").alias("n_turns"), F.array_join(F.transform("m", lambda x: F.concat(head(x), x["text"], F.lit(END))), "").alias("formatted"), F.filter(spans, lambda x: x.isNotNull()).alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """A formatted conversation's turns: array of (role, text), unescaped."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda p: p != "")
    body = lambda p: F.substr(p, F.lit(len(START) + 1))
    cut = lambda p: F.instr(body(p), "\n")
    return F.transform(pieces, lambda p: F.struct(unescape_role(F.substr(body(p), F.lit(1), cut(p) - 1)).alias("role"), unescape(F.substr(body(p), cut(p) + 1)).alias("text")))


def under_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped span by span."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
