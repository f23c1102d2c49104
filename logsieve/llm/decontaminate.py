"""Benchmark decontamination with suffix arrays over the training texts.

Every task takes its documents in shards (Arrow batches), turns the words of a shard into numbers
and sorts the shard's suffixes; every suffix of every benchmark item is then binary-searched in
it. That gives the places where a benchmark window occurs verbatim, and from each place the longest
match. No training text is shuffled: the benchmark travels to the documents.

Only suffixes that can match are kept in a shard's array: those whose first words (up to three)
begin some benchmark window. This drops no match, and leaves the array small.

A window is ``window`` consecutive words of an item; an item with fewer words, but not none, is
one window. A document word inside any occurrence of a window is hit. Words: A-Z lower-cased,
then runs of characters other than ASCII ones that are neither digits nor letters.

Windows that several items share are one window, so a place of the text has at most one match of each length up to
``window``, however often the benchmark repeats itself.

The benchmark is broadcast in blocks of at most ``block_words`` words (32 MB or so in a worker). If one block holds it, the documents pass
once and nothing is stored. Else they are written with a key to the shared folder; each block passes over their texts, and gives rows for
the documents that it hits only; its broadcast is removed before the next one. No block is skipped and results don't depend on
the block size. An item longer than a block is
cut into overlapping parts, so that each of its windows lies whole in one part.

Defined results: null or empty text has no words, no hits and isn't contaminated; null or empty
items, and items without words, have no window; items of equal id count once; a null item id is
written as the empty string. Repeated documents are judged each on its own. Other columns pass
through; the added columns are ``n_words``, ``n_hit``, ``items`` and, if asked for, ``matches``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsieve.llm.common import cut, free_names

WINDOW = 13
HEAD = 3
ADDED = ("n_words", "n_hit", "items", "matches")
BLOCK_WORDS = 1_000_000
#: Bytes of text in one suffix array; a longer text is a shard of its own.
SHARD_BYTES = 4 << 20
#: A-Z to a-z; ASCII characters other than digits and letters to a space; bytes of other characters stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or c >= 97 and c <= 122 or c >= 128 else 32 for c in range(256))

MATCH = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("doc_word", T.LongType()),
                      T.StructField("item_word", T.LongType()), T.StructField("n_words", T.LongType())])
SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
FOUND = [T.StructField("hits", T.ArrayType(SPAN)), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("matches", T.ArrayType(MATCH))]
#: Texts whose results go to Spark at a time.
BATCH = 256


def words(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class Index:
    """The windows of one block of items, sorted for binary search."""

    def __init__(self, items: list[tuple[str, list[bytes], int]], window: int):
        self.window = window
        vocab = sorted({w for _, ws, _ in items for w in ws})
        self.vocab = {w: i + 1 for i, w in enumerate(vocab)}  # 0: a word of no item, or the end
        self.ids = [i for i, _, _ in items]
        self.first = np.array([f for _, _, f in items], dtype=np.int64)
        lengths = [len(ws) for _, ws, _ in items]
        flat = np.array([self.vocab[w] for _, ws, _ in items for w in ws], dtype=np.int32)
        # All items one after the other, each followed by ``window`` zeros.
        self.text = np.zeros(sum(lengths) + (len(items) + 1) * window, dtype=np.int32)
        starts, at, took = [], 0, 0
        self.begin = np.zeros(len(items), dtype=np.int64)
        self.item_of, self.length = [], []
        for k, n in enumerate(lengths):
            self.text[at:at + n] = flat[took:took + n]
            self.begin[k] = at
            m = max(1, n - window + 1)
            starts.append(np.arange(at, at + m))
            self.item_of.append(np.full(m, k))
            self.length.append(np.full(m, min(n, window)))
            at, took = at + n + window, took + n
        cat = lambda xs: np.concatenate(xs) if xs else np.zeros(0, dtype=np.int64)
        self.starts, self.item_of, self.length = cat(starts), cat(self.item_of), cat(self.length)
        # Equal windows are one: the first of them. Its items are holders[holds[w]:holds[w + 1]].
        _, first, same = np.unique(self.rows(self.text, self.starts), return_index=True, return_inverse=True)
        pairs = np.unique(np.stack([same.reshape(-1), self.item_of], axis=1), axis=0) if len(first) else np.zeros((0, 2), dtype=np.int64)
        self.holders, self.holds = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(first) + 1))
        self.starts, self.item_of, self.length = self.starts[first], self.item_of[first], self.length[first]
        self.heads = {int(k): np.unique(self.hashed(self.text, self.starts[np.minimum(self.length, HEAD) == k], int(k)))
                      for k in np.unique(np.minimum(self.length, HEAD))}

    @staticmethod
    def hashed(text: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        """A number for the k <= 3 words from each place: exact, words have 21 bits at most."""
        out = text[at].astype(np.int64)
        for i in range(1, k):
            out = (out << 21) | text[at + i]
        return out

    def rows(self, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The first ``window`` words from each place as byte strings that sort like the words."""
        grid = text[at[:, None] + np.arange(self.window)]
        gone = np.cumsum(grid == 0, axis=1) > 0  # nothing past an end or a foreign word counts
        grid = np.where(gone, 0, grid).astype(">u4")
        return np.ascontiguousarray(grid).view(f"S{4 * self.window}").ravel()

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document places, window numbers) of all occurrences in ``text``, which ends in zeros."""
        here = np.zeros(len(text), dtype=bool)
        known = np.flatnonzero(text[:len(text) - self.window])
        for k, heads in self.heads.items():
            at = known
            for i in range(1, k):
                at = at[text[at + i] > 0]
            key = self.hashed(text, at, k)
            pos = np.minimum(np.searchsorted(heads, key), len(heads) - 1)
            here[at[heads[pos] == key]] = True
        places = np.flatnonzero(here)
        if not len(places):
            return places, places
        suffixes = self.rows(text, places)  # the shard's suffix array: places in the order of their suffixes
        order = np.argsort(suffixes, kind="stable")
        places, suffixes = places[order], suffixes[order]
        low_keys = self.rows(self.text, self.starts)
        low = np.searchsorted(suffixes, low_keys, side="left")
        high = np.searchsorted(suffixes, low_keys, side="right")
        for s in np.flatnonzero(self.length < self.window):  # a short item: all suffixes that begin with it
            n = int(self.length[s])
            top = np.full(self.window, 0xFFFFFFFF, dtype=">u4")
            top[:n] = self.text[self.starts[s]:self.starts[s] + n]
            high[s] = np.searchsorted(suffixes, top.view(f"S{4 * self.window}")[0], side="right")
        count = high - low
        which = np.repeat(np.arange(len(self.starts)), count)
        within = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        return places[np.repeat(low, count) + within], which

    def extend(self, text: np.ndarray, at: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Words of the longest match from each occurrence on."""
        n = self.length[which].copy()
        live = np.arange(len(at))
        while len(live):
            a, b = at[live] + n[live], self.starts[which[live]] + n[live]
            ok = (a < len(text)) & (b < len(self.text))
            a, b, live = a[ok], b[ok], live[ok]
            same = (text[a] == self.text[b]) & (text[a] > 0)
            live = live[same]
            n[live] += 1
        return n


def spans_of(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of True."""
    edge = np.diff(hit.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def scan_shard(index: Index, texts: list[bytes | None], matches: bool) -> list[tuple[int, list, list, list]]:
    """(words, hit spans, items, longest matches) of every text. From each place the longest match is given, at its first place in the
    benchmark; a match that goes on from the place before is part of that one."""
    per_doc = [words(t) for t in texts]
    counts = np.array([len(w) for w in per_doc], dtype=np.int64)
    gap = index.window
    begin = np.cumsum(counts + gap) - (counts + gap)
    text = np.zeros(int((counts + gap).sum()) + gap, dtype=np.int32)
    get = index.vocab.get
    for b, n, ws in zip(begin, counts, per_doc, strict=True):
        text[b:b + n] = np.fromiter(map(get, ws, repeat(0)), dtype=np.int32, count=n)
    at, which = index.search(text)
    edge = np.zeros(len(text) + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + index.length[which], -1)
    low, high = spans_of(np.cumsum(edge[:-1]) > 0)
    span_doc = np.searchsorted(begin, low, side="right") - 1  # a span lies whole in its text: gaps part them
    spans = np.searchsorted(span_doc, np.arange(len(texts) + 1))
    # Windows of each text, once; then their items.
    pairs = np.unique((np.searchsorted(begin, at, side="right") - 1) * np.int64(len(index.starts) + 1) + which)
    doc, window = pairs // (len(index.starts) + 1), pairs % (len(index.starts) + 1)
    windows = np.searchsorted(doc, np.arange(len(texts) + 1))
    longest = _longest(index, text, at, which) if matches else None
    out = []
    for k in range(len(texts)):
        hits = [{"start": int(a - begin[k]), "end": int(b - begin[k])} for a, b in zip(low[spans[k]:spans[k + 1]], high[spans[k]:spans[k + 1]], strict=True)]
        mine = window[windows[k]:windows[k + 1]]
        items = np.unique(np.concatenate([index.holders[index.holds[w]:index.holds[w + 1]] for w in mine])) if len(mine) else ()
        found = []
        if longest is not None:
            place, n, item, item_word = longest
            for i in range(*np.searchsorted(place, (begin[k], begin[k] + counts[k]))):
                found.append({"item_id": index.ids[item[i]], "doc_word": int(place[i] - begin[k]), "item_word": int(item_word[i]), "n_words": int(n[i])})
        out.append((int(counts[k]), hits, sorted({index.ids[i] for i in items}), found))
    return out


def _longest(index: Index, text: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, ...]:
    """(place, words, item, item word): the longest match from every place, without those that lie in the one from the place before."""
    n = index.extend(text, at, which)
    order = np.lexsort((index.starts[which], -n, at))
    at, which, n = at[order], which[order], n[order]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    at, which, n = at[first], which[first], n[first]
    before = np.zeros(len(text) + 1, dtype=np.int64)
    before[at + 1] = n
    own = n >= before[at]
    at, which, n = at[own], which[own], n[own]
    item = index.item_of[which]
    return at, n, item, index.starts[which] - index.begin[item] + index.first[item]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> Iterator[list]:
    """The items in blocks of about ``block_words`` words, one block on the driver at a time."""
    rows = benchmark.where(F.col(text_col).isNotNull()).select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).cast("string").alias("t"))
    block, size = [], 0
    for r in rows.toLocalIterator():
        ws = words(r.t.encode())
        for lo in range(0, max(1, len(ws) - window + 1), block_words):
            part = ws[lo:lo + block_words + window - 1]
            if part:
                block.append((r.i, part, lo))
                size += len(part)
            if size >= block_words:
                yield block
                block, size = [], 0
    if block:
        yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS,
                  keep: list[str] | None = None, matches: bool = True) -> DataFrame:
    """``docs`` (its columns ``keep``; all by default) with ``n_words``, ``n_hit``, ``items`` (item ids
    as strings, sorted) and, with ``matches``, ``matches`` (item_id, doc_word, item_word, n_words: longest verbatim
    matches and their places). A column of ``docs`` with one of these four names, in any case, is replaced."""
    sc = docs.sparkSession.sparkContext
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ADDED]
    src = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text_col])])
    words_, found, key = free_names(["_words", "_found", "_key"], src.columns)
    state = T.StructType([T.StructField(words_, T.LongType()), T.StructField(found, T.StructType(FOUND))])
    blocks = _blocks(benchmark, item_id, item_text, window, block_words)
    block, more = next(blocks, []), next(blocks, None)
    if more is None:
        schema = T.StructType([f for f in src.schema if f.name in keep] + state.fields)
        out = src.mapInArrow(_scanner(sc.broadcast((block, window)), text_col, schema.names, words_, found, matches, False), schema)
    else:
        counted = T.StructType(src.schema.fields + state.fields[:1])
        base = cut(src.mapInArrow(_scanner(sc.broadcast(([], window)), text_col, counted.names, words_, None, False, False), counted).withColumn(
            key, F.monotonically_increasing_id()))
        narrow = base.select(key, F.col(f"`{text_col}`"))
        parts = None
        while block:
            shared = sc.broadcast((block, window))
            schema = T.StructType([narrow.schema[key], *state.fields[1:]])
            part = cut(narrow.mapInArrow(_scanner(shared, text_col, schema.names, words_, found, matches, True), schema))
            shared.destroy()
            parts = part if parts is None else parts.unionByName(part)
            block, more = more, next(blocks, None)
        s = F.col(found)
        whole = parts.groupBy(key).agg(F.struct(
            F.array_sort(F.flatten(F.collect_list(s["hits"]))).alias("hits"), F.flatten(F.collect_list(s["items"])).alias("items"),
            F.flatten(F.collect_list(s["matches"])).alias("matches")).alias(found))
        out = base.join(whole, key, "left").drop(key)
    s = F.col(found)
    # Spans in order: each adds what reaches beyond the ones before it.
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    n_hit = F.aggregate(F.coalesce(s["hits"], F.array().cast(FOUND[0].dataType)), zero, lambda a, h: F.struct(
        (a["n"] + F.greatest(h["end"] - F.greatest(h["start"], a["upto"]), F.lit(0))).alias("n"), F.greatest(a["upto"], h["end"]).alias("upto")))
    items = F.array_sort(F.array_distinct(F.coalesce(s["items"], F.array().cast("array<string>"))))
    return out.select(*[F.col(f"`{c}`") for c in keep], F.col(words_).alias("n_words"), n_hit["n"].alias("n_hit"), items.alias("items"),
                      *([F.coalesce(s["matches"], F.array().cast(FOUND[2].dataType)).alias("matches")] if matches else []))


def _scanner(shared, text_col: str, names: list[str], words_: str, found: str | None, matches: bool, hit_only: bool):
    """Batches with the columns ``names``: those of the documents, their number of words, and what was found in them; ``hit_only``: only of those in
    which something was."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, kind = Index(*shared.value), None
        for b in batches:
            kind = kind or found_type()
            texts, lo = b.column(text_col).cast(pa.large_binary()).to_pylist(), 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and hi < lo + BATCH and (hi == lo or size < SHARD_BYTES):
                    size += len(texts[hi] or b"")
                    hi += 1
                got = scan_shard(index, texts[lo:hi], matches)
                part = b.slice(lo, hi - lo)
                if hit_only:
                    some = [i for i, g in enumerate(got) if g[1]]
                    got, part = [got[i] for i in some], part.take(pa.array(some, pa.int64()))
                added = {words_: pa.array([g[0] for g in got], pa.int64()),
                         found: pa.array([{"hits": g[1], "items": g[2], "matches": g[3]} for g in got], kind)}
                yield pa.RecordBatch.from_arrays([added[c] if c in added else part.column(c) for c in names], names=names)
                lo = hi
    return run


def found_type() -> pa.DataType:
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    match = pa.struct([("item_id", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())])
    return pa.struct([("hits", pa.list_(span)), ("items", pa.list_(pa.string())), ("matches", pa.list_(match))])
