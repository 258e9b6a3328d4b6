"""Token counts under a unigram model, by dynamic programming shared along a trie of distinct pre-tokens.

Pre-tokens are the words of a text (between white space), each with the word mark in front. The forward score of a prefix
depends on the prefix alone, so the distinct pre-tokens of a partition are inserted into a trie: a node holds its prefix's
best score and number of tokens, worked out once from the nodes above it, and its children. An automaton of the vocabulary
says which pieces end at a node, so no others are tried. What a word's last node holds is its terminal count, which is
stored for the word; a text's count is the sum over its words.

Vocabulary: the pieces of a public SentencePiece file, which is never trained. Its ids are ranks, so a piece of rank r gets
the unigram score -log(r + 1) (Zipf's law), byte pieces apart; a character outside the vocabulary falls back to its UTF-8
bytes, one token and a fixed penalty each. The best segmentation has the greatest score; on equal scores the fewest tokens.

Nothing is shuffled. A partition's trie is emptied past `most_nodes` nodes and its stored counts past `most_words` words,
which costs time only. Edge cases: null, empty or blank text counts 0; repeated rows give repeated rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.llm.common import small_batches, text_of

MARK = "▁"
_BYTE_PENALTY = -20.0
_MODELS: dict[str, dict[str, float]] = {}


def scores(path: str) -> dict[str, float]:
    """Unigram scores of the pieces of a SentencePiece file."""
    if path not in _MODELS:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        _MODELS[path] = {sp.id_to_piece(i): -math.log(i + 1) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    return _MODELS[path]


class Pieces:
    """An automaton of the vocabulary: `ends[state]` are the (length, score) of all pieces that end where the state stands."""

    def __init__(self, model: dict[str, float]):
        self.goto, self.fail, self.ends = [{}], [0], [()]
        for piece, p in model.items():
            at = 0
            for c in piece:
                if c not in self.goto[at]:
                    self.goto[at][c] = len(self.goto)
                    self.goto.append({})
                    self.fail.append(0)
                    self.ends.append(())
                at = self.goto[at][c]
            if at:
                self.ends[at] = ((len(piece), p),)
        level = list(self.goto[0].values())
        while level:  # shorter states first
            for at in level:
                self.ends[at] += self.ends[self.fail[at]]
                for c, to in self.goto[at].items():
                    self.fail[to] = self.after(self.fail[at], c)
            level = [to for at in level for to in self.goto[at].values()]

    def after(self, at: int, c: str) -> int:
        goto = self.goto
        while (to := goto[at].get(c)) is None:
            if not at:
                return 0
            at = self.fail[at]
        return to


class Trie:
    """Prefixes with their forward scores: node i has best score `score[i]`, `tokens[i]` tokens of it, the automaton's
    `state[i]`; `below` has its child by `i << 21 | character`. A node is no object of its own, so however many there are,
    Python's garbage collector has nothing to walk through.
    """

    def __init__(self, model: dict[str, float]):
        self.pieces = Pieces(model)
        self.empty()

    def empty(self) -> None:
        self.score, self.tokens, self.state, self.below = [0.0], [0], [0], {}

    def count(self, word: str) -> int:
        """The word's terminal count; makes the nodes that are missing."""
        score, tokens, state, below, after, ends = self.score, self.tokens, self.state, self.below, self.pieces.after, self.pieces.ends
        node, path = 0, [0]
        for c in word:
            key = node << 21 | ord(c)
            child = below.get(key)
            if child is None:
                at = after(state[node], c)
                n = 1 if c < "\x80" else len(c.encode("utf-8", "replace"))
                s, t = score[node] + n * _BYTE_PENALTY, tokens[node] + n
                for long, p in ends[at]:
                    start = path[-long]
                    v = score[start] + p
                    if v > s or v == s and tokens[start] + 1 < t:
                        s, t = v, tokens[start] + 1
                child = below[key] = len(score)
                score.append(s)
                tokens.append(t)
                state.append(at)
            node = child
            path.append(node)
        return tokens[node]


def token_counts(docs: DataFrame, vocabulary: str, *, text: str = "text", most_words: int = 2_000_000, most_nodes: int = 1_000_000) -> DataFrame:
    """docs with `n_pretokens` and `n_tokens` added (columns of these names are replaced)."""
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("n_pretokens", "n_tokens")]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        trie, known = Trie(scores(vocabulary)), {}
        for batch in batches:
            lists = [t.split() for t in batch["_text"].to_pylist()]
            if len(known) > most_words:
                known.clear()
            for word in sorted(set().union(*lists).difference(known)):  # neighbours share most of their way
                if len(trie.score) > most_nodes:
                    trie.empty()
                known[word] = trie.count(MARK + word)
            get = known.__getitem__
            yield pa.RecordBatch.from_arrays([batch["_row"], pa.array([len(x) for x in lists], pa.int64()), pa.array([sum(map(get, x)) for x in lists], pa.int64())], ["_row", "n_pretokens", "n_tokens"])

    df = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), text_of(text).alias("_text"))
    out = df.mapInArrow(run, T.StructType([df.schema["_row"], T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())]))
    return out.select("_row.*", "n_pretokens", "n_tokens")
