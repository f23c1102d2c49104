"""Harmonic packing of tokenised documents into sequences of bounded length.

Method. Documents are cut into whole capacities, and the rests partitioned by length into reciprocal-capacity classes: class k holds
lengths in (capacity / (k + 1), capacity / k], the last class (``classes``) also the shorter ones. A bin of class k takes exactly k rests, uncut;
what it then lacks to its capacity is cut from the documents that come next, so that full bins carry no padding.
Bins are filled independently by every task, in the order of its rows, and need no shuffle: a task's state is an open
bin for each class and the few that wait to be filled up. At the end of a task what these hold is laid end to end into full
sequences, and the last one is cut into powers of two, which a trainer takes unpadded. The cost is cuts: a sequence has one or two.
``smallest`` trades padding for fewer of them: a bin that lacks less is closed as it is.

Sequence ids are ``task number * 2**40 + count``: unique, dense within a task, and the same when
a lost task is run again on the same input split.

Token ids are those of the given ``tokenizers`` file. A control string in a text gets its control id, as that library does by
default; with ``control_as_text`` it is ordinary text, which is what training on untrusted texts wants.
The same vocabulary as ranks (``tiktoken``) gives the same ids about four times as fast; it is used for
texts of plain Latin characters without very long runs or control strings, and ``tokenizers`` itself for all others.

Defined results: null text is an empty document, whose only id is the end id; an empty table
gives no rows; repeated rows and repeated or null document ids are packed each on its own; columns
other than the id and the text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

CAPACITY = 2048
END_ID = 1
SEQUENCES_PER_TASK = 1 << 40
#: Token ids of one output batch, and texts encoded at a time.
BATCH_IDS = 2_000_000
#: Classes; a rest shorter than capacity / CLASSES goes to the last.
CLASSES = 64
#: ASCII and Latin letters, for which the two libraries' character classes are the same.
PLAIN = re.compile("[\t\n\r -~¡-¬®-ſ‐-…]*")
LONG_RUN = re.compile(r"[^ \t\n\r]{400}")


def encoder(vocab: str, ranks: str | None = None, pattern: str | None = None, control_as_text: bool = False):
    """text -> ids. Either library is loaded when a text first needs it."""
    loaded: dict = {}

    def whole(text: str) -> list[int]:
        if "slow" not in loaded:
            from tokenizers import Tokenizer

            loaded["slow"] = Tokenizer.from_file(vocab)
            loaded["slow"].encode_special_tokens = control_as_text
        return loaded["slow"].encode(text, add_special_tokens=False).ids

    def plain(text: str) -> list[int]:
        if "fast" not in loaded:
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            loaded["fast"] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        return loaded["fast"].encode_ordinary(text)

    def controls() -> list[str]:
        if "controls" not in loaded:
            import json

            with open(vocab, encoding="utf-8") as f:
                loaded["controls"] = [] if control_as_text else [t["content"] for t in json.load(f).get("added_tokens", [])]
        return loaded["controls"]

    if not (ranks and pattern):
        return whole
    return lambda text: plain(text) if PLAIN.fullmatch(text) and not LONG_RUN.search(text) and not any(c in text for c in controls()) else whole(text)


class Bins:
    """A task's bins: gives every piece (key, start, length, data, tokens) its sequence and offset once its bin is full."""

    def __init__(self, first: int, capacity: int = CAPACITY, classes: int = CLASSES, smallest: int = 1):
        self.next, self.capacity, self.classes, self.smallest = first, capacity, classes, smallest
        self.open: dict[int, list[tuple]] = {}
        self.waiting: list[tuple[list[tuple], int]] = []  # bins with their rests, and what they lack

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for piece in pieces:
            yield *piece, self.next, at
            at += piece[2]
        self.next += 1

    def put(self, key, ids: np.ndarray) -> Iterator[tuple]:
        n, at = len(ids), 0

        def cut(k: int) -> tuple:
            nonlocal at
            at += k
            return key, at - k, k, ids[at - k:at].tobytes(), n

        while self.waiting and at < n:
            pieces, lack = self.waiting.pop(0)
            pieces.append(cut(min(lack, n - at)))
            if lack == pieces[-1][2]:
                yield from self._close(pieces)
            else:
                self.waiting.insert(0, (pieces, lack - pieces[-1][2]))
        while n - at >= self.capacity:
            yield from self._close([cut(self.capacity)])
        if at < n:
            k = min(self.classes, self.capacity // (n - at))
            pieces = self.open.setdefault(k, [])
            pieces.append(cut(n - at))
            if len(pieces) == k:
                lack = self.capacity - sum(p[2] for p in self.open.pop(k))
                if lack < self.smallest:
                    yield from self._close(pieces)
                else:
                    self.waiting.append((pieces, lack))

    def end(self) -> Iterator[tuple]:
        """What is left, laid end to end into sequences of the capacity, then of falling powers of two."""
        left = [p for pieces, _ in self.waiting for p in pieces] + [p for k in sorted(self.open) for p in self.open[k]]
        self.open, self.waiting = {}, []
        total, here = sum(p[2] for p in left), []
        room = 0
        for key, start, n, data, tokens in left:
            at = 0
            while at < n:
                if not room:
                    room = self.capacity if total >= self.capacity else 1 << (total.bit_length() - 1)
                    total -= room
                k = min(room, n - at)
                here.append((key, start + at, k, data[4 * at:4 * (at + k)], tokens))
                at, room = at + k, room - k
                if not room:
                    yield from self._close(here)
                    here = []


def pack(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         end_id: int = END_ID, smallest: int = 1, classes: int = CLASSES, ranks: str | None = None, pattern: str | None = None,
         control_as_text: bool = False) -> DataFrame:
    """One row per piece: (id, start, length, doc_tokens, sequence_id, offset, ids).

    ``ids`` holds the piece's token ids as little-endian unsigned 32-bit numbers. ``vocab`` (and,
    for speed, ``ranks`` with its ``pattern``) are files of the tokenizer that every executor can read.
    """
    if capacity < 1 or capacity & (capacity - 1) or not 0 < classes <= capacity or smallest < 1:
        raise ValueError("capacity must be a power of two, classes and smallest positive")
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocab, ranks, pattern, control_as_text)
        bins, out, held, id_type = Bins(TaskContext.get().partitionId() * SEQUENCES_PER_TASK, capacity, classes, smallest), [], 0, None

        def flush() -> pa.RecordBatch:
            ids, start, length, data, total, seq, off = zip(*out, strict=True)
            longs = [pa.array(x, type=pa.int64()) for x in (start, length, total, seq, off)]
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, type=id_type), *longs, pa.array(data, type=pa.binary())], names=names)

        for b in batches:
            id_type = b.schema.field(0).type
            keys, texts = b.column(0).to_pylist(), b.column(1)
            for key, text in zip(keys, texts, strict=True):
                text = text.as_py()
                ids = np.array([*(encode(text) if text else ()), end_id], dtype="<u4")
                held += len(ids)
                out.extend(bins.put(key, ids))
                if held >= BATCH_IDS and out:
                    yield flush()
                    held = 0
        out.extend(bins.end())
        if out:
            yield flush()

    table = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(
        run, f"id {kind}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")
    return table.withColumnRenamed("id", id_col)
