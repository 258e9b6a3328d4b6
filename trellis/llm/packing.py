"""Sum-of-squares online packing of token sequences.

A document's ids (and an end id) are cut into full windows; the rest is placed online. N(h) is the number of open windows
filled to level h, kept in a level array; the rest goes to the level (or a new window) for which the sum of N(h)**2 over
partially filled windows grows least, the fullest such level on a tie. A window is emitted when it is full. What is open
at the end of a partition is closed up by cutting freely: its pieces are laid end to end into full windows, and the last
one is split into powers of two, which need no padding.

Each partition is packed by itself, so nothing is shuffled, no key can be hot and a lost task is simply packed again;
memory is the open windows of one partition. `sequence_id` is the partition's number times 2**32 plus a count.

Edge cases: null or empty text is the end id alone. Null or repeated doc_ids are carried as they are, one document a row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.llm.common import small_batches, text_of, trimmed

_SPECIAL = "<|endoftext|>"
_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """text -> uint32 ids of the byte-level BPE in a `tokenizers` file.

    A tiktoken encoding over the same merges gives the same ids several times as fast; a text that spells a special token
    goes to the tokenizers library itself, which makes that token of it, and so does one that tiktoken cannot split. A test
    holds both against each other.
    """
    if path not in _ENCODERS:
        import json

        import tiktoken
        from tokenizers import Tokenizer

        slow = cache(lambda: Tokenizer.from_file(path))  # read only if a text needs it
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # how byte-level BPE writes bytes as characters
        rest = [b for b in range(256) if b not in shown]
        as_byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(as_byte[c] for c in piece): i for piece, i in vocab.items() if piece != _SPECIAL}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        fast = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> np.ndarray:
            if _SPECIAL not in text:
                try:
                    return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
                except ValueError:  # its regex gives up on a run of about a million blanks
                    pass
            return np.array(slow().encode(text, add_special_tokens=False).ids, np.uint32)

        _ENCODERS[path] = encode
    return _ENCODERS[path]


class Packer:
    """Places pieces online; `out` gathers (tag, start, ids, doc_tokens, sequence, offset) of closed windows."""

    def __init__(self, size: int, first: int = 0):
        self.size, self.next, self.out = size, first, []
        self.count = np.zeros(size + 1, np.int64)  # the level array; windows at 0 and size are not partially filled
        self.open: list[list] = [[] for _ in range(size + 1)]

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def level(self, n: int) -> int:
        """Where a piece of n < size goes: the level of least growth of the sum of squares, 0 for a new window."""
        room = self.size - n
        grow = 2 * self.count[n : self.size + 1] + 1
        grow[-1] = 0  # filled up
        leave = 2 * self.count[: room + 1] - 1
        leave[0] = 0
        change = np.where(self.count[: room + 1] > 0, grow - leave, np.iinfo(np.int64).max)
        change[0] = grow[0] if n < self.size else 0
        return room - int(np.argmin(change[::-1]))

    def add(self, tag, ids: np.ndarray) -> None:
        n, total = self.size, len(ids)
        for start in range(0, total - total % n, n):
            self.out.append((tag, start, ids[start : start + n], total, self._new(), 0))
        if not (rest := total % n):
            return
        h = self.level(rest)
        window = self.open[h].pop() if h else []
        window.append((tag, total - rest, ids[total - rest :], total))
        if h:
            self.count[h] -= 1
        if h + rest == n:
            self._close(window)
        else:
            self.open[h + rest].append(window)
            self.count[h + rest] += 1

    def _close(self, window: list) -> None:
        seq, at = self._new(), 0
        for tag, start, ids, total in window:
            self.out.append((tag, start, ids, total, seq, at))
            at += len(ids)

    def finish(self) -> None:
        pieces = [p for h in range(self.size, 0, -1) for w in self.open[h] for p in w]
        self.open, self.count[:] = [[] for _ in range(self.size + 1)], 0
        left = sum(len(p[2]) for p in pieces)
        rooms = [self.size] * (left // self.size) + [1 << b for b in range(left.bit_length(), -1, -1) if left % self.size >> b & 1]
        window, room = [], rooms.pop(0) if rooms else 0
        for tag, start, ids, total in pieces:
            while len(ids):
                window.append((tag, start, ids[:room], total))
                start, room, ids = start + min(room, len(ids)), room - min(room, len(ids)), ids[room:]
                if not room:
                    self._close(window)
                    window, room = [], rooms.pop(0) if rooms else 0


def pack(docs: DataFrame, tokenizer: str, *, size: int = 1024, end_id: int = 0, doc: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and `ids` if asked for).

    tokenizer is the path of a tokenizers file on every machine. Windows hold `size` ids.
    """
    small_batches(docs.sparkSession)
    kinds = docs.select(F.col(doc).alias("doc_id")).schema

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        encode, packer = encoder(tokenizer), Packer(size, TaskContext.get().partitionId() << 32)
        end = np.array([end_id], np.uint32)

        def ready(ids_type):
            rows, packer.out = packer.out, []
            cols = [pa.array([r[0] for r in rows], ids_type), *(pa.array(x, pa.int64()) for x in ([r[1] for r in rows], [len(r[2]) for r in rows], [zlib.crc32(r[2].astype("<u4").tobytes()) for r in rows], [r[3] for r in rows], [r[4] for r in rows], [r[5] for r in rows]))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                cols.append(pa.array([r[2].astype(np.int64) for r in rows], pa.list_(pa.int64())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(cols, names)

        kind = None
        for batch in batches:
            kind = batch["_doc"].type
            for d, t in zip(batch["_doc"].to_pylist(), batch["_text"], strict=True):
                packer.add(d, np.concatenate((encode(t.as_py()), end)))
                if len(packer.out) >= 20_000:
                    yield ready(kind)
        packer.finish()
        if packer.out:
            yield ready(kind)

    schema = T.StructType([*kinds, *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), *[T.StructField("ids", T.ArrayType(T.LongType()))] * with_ids])
    return docs.select(F.col(doc).alias("_doc"), text_of(text).alias("_text")).mapInArrow(trimmed(run), schema)
