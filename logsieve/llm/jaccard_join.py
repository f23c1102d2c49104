"""N-gram Jaccard join: links between texts whose sets of word shingles overlap by a share or more.

A document's set holds its distinct shingles of ``shingle`` consecutive words; A-Z count as a-z. Two documents
link when 100 x intersection >= ``percent`` x union. Result: one row per document with its component of links.

Method: prefix filtering, rare shingles first.

1. Equal sets become one representative, so copies are never paired. The order of shingles: those whose hash is divisible by
   ``anchors`` first, by how many documents hold them (copies seen by one task count once), then by hash; the others by hash. Only the anchors need counting.
2. A set of n shingles can only link to sets that share one of its first n - ceil(percent n / 100) + 1 shingles; to sets not smaller than
   itself, one of its first n - ceil(2 percent n / (100 + percent)) + 1. These prefix shingles are joined, by size classes that differ
   by the share (sets that link are of one class or of neighbours): those without a partner go, the others tie their sets to one of them by
   an edge (a star, no pairs). Every link lies inside one component of these edges, its candidate group.
3. A group's texts meet in one task if they are few bytes. Larger groups are cut into blocks whose pairs meet, and still
   larger ones are grouped by prefix shingle first, each again in blocks; a pair is then looked at under its first
   common prefix shingle only.
4. There, sets are taken by size and joined on prefix shingles, rare ones of the group first, with the length filter (sizes within the share),
   the positional filter (shingles still to come after the last common prefix shingle) and the suffix filter
   (both sets split at pivots of the order; the smaller parts add up to the largest possible overlap). Each pair left is
   verified once, by the shingles themselves.
5. Links go out as an edge to the smallest set of the local component and a number. The edges of a group that met whole, or in blocks, are settled
   in one task; those of groups cut by shingle by minimum labels.

Only a bitmap of the rows to fetch, of fixed size, passes the driver; it is made in steps.
Texts are read twice (shingles, candidates); pass a written table. No text that has no
candidate is shuffled. Joins on frequent sets are by broadcast of under a thousand keys.

Defined results: with fewer words than the shingle, the whole sequence is the one shingle; null texts and texts without words
have an empty set, which links with nothing (component: the own id; also of such rows with equal ids). Rows
with equal ids are rows of their own. A null id is no candidate for the smallest id (a component of null ids has a
null id). Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.llm.common import cut

SHINGLE = 3
PERCENT = 90
SEED = 42
#: One of so many shingles is an anchor: enough for a prefix of a tenth, with the rarest to choose from.
ANCHORS = 6
#: Bits of the bitmap of rows to fetch: a power of two. It travels in blocks.
BITMAP = 1 << 26
BLOBS = 32
#: Blobs that one task adds up.
FAN_IN = 256
#: Bytes of text of one block of a group, and the blocks beyond which a group is cut by prefix shingle.
BLOCK_BYTES = 1 << 20
MOST_BLOCKS = 16
#: Sets that a task remembers, to give a copy's shingles once.
SEEN = 1 << 18
#: Shingles hashed at a time, so that a very long text needs bounded memory.
HASH_SLICE = 65_536
#: Parts of the suffix filter.
PARTS = 16
#: A set with over one HOT-th of the rows is joined by broadcast; there are fewer than HOT.
HOT = 1000


def shingles(text: bytes, k: int) -> Iterator[bytes]:
    """The shingles of a text in order, repeats included."""
    words = text.lower().split()  # bytes: A-Z and the six white-space bytes only
    if words and len(words) < k:
        words, k = [b" ".join(words)], 1
    return map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)) if k > 1 else iter(words)


def hashed(text: bytes | None, k: int) -> np.ndarray:
    """The distinct shingles' XXH64 values, sorted."""
    import xxhash

    digest, found = xxhash.xxh64_intdigest, []
    grams = shingles(text or b"", k)
    while len(part := np.fromiter(map(digest, islice(grams, HASH_SLICE), repeat(SEED)), dtype=np.uint64)):
        found.append(np.unique(part))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint64)


def set_key(hashes: np.ndarray) -> bytes:
    """128 bits that name a set."""
    import xxhash

    return xxhash.xxh3_128_digest(hashes.tobytes())


def short_key(key: bytes | None) -> int | None:
    return None if key is None else int.from_bytes(key[:8], "little", signed=True)


def prefix_size(n: int, percent: int) -> int:
    """Shingles of which a linked set must share one; 0 if only an equal set can link."""
    return n + (-percent * n // 100) + 1 if 100 * n >= percent * (n + 1) else 0


def index_size(n: int, percent: int) -> int:
    """Shingles of which a linked set that isn't smaller must share one."""
    return n + (-2 * percent * n // (100 + percent)) + 1


# ---------------------------------------------------------------------------
# A bitmap of fixed size, made by many tasks
# ---------------------------------------------------------------------------

BLOB = "blob int, part bigint, data binary"


def blobs(array: np.ndarray, part: int) -> Iterator[tuple[int, int, bytes]]:
    for i, x in enumerate(np.split(array, BLOBS)):
        yield i, part, zlib.compress(x.tobytes(), 1)


def united(df: DataFrame) -> np.ndarray:
    """The bitwise or of the arrays that tasks gave as ``blobs``, ``FAN_IN`` at a time."""
    def merge(table: pa.Table) -> pa.Table:
        total = None
        for data in table["data"]:
            x = np.frombuffer(zlib.decompress(data.as_py()), dtype=np.uint8)
            total = x if total is None else total | x
        return pa.table({"blob": table["blob"].slice(0, 1), "part": table["to"].slice(0, 1), "data": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    parts = df.agg(F.max("part")).first()[0]
    while parts:  # number of the last part
        df = cut(df.withColumn("to", F.floor(F.col("part") / FAN_IN)).groupBy("blob", "to").applyInArrow(merge, BLOB))
        parts //= FAN_IN
    rows = sorted(df.collect())  # BLOBS rows
    return np.concatenate([np.frombuffer(zlib.decompress(r.data), dtype=np.uint8) for r in rows]) if rows else np.zeros(0, dtype=np.uint8)


def part_number() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


# ---------------------------------------------------------------------------
# Passes over the texts
# ---------------------------------------------------------------------------

def _described(k: int, percent: int, anchors: int):
    """For each text its set's key and size; of sets that can link to another, once a task: the anchors, and as many of
    the other shingles as the prefix needs beyond them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            keys, sizes, first, rest = [], [], [], []
            for t in b.column(1).cast(pa.large_binary()):
                h = hashed(t.as_py(), k)
                key, p = set_key(h) if len(h) else None, prefix_size(len(h), percent)
                keys.append(key)
                sizes.append(len(h))
                if not p or key in seen:
                    first.append(None)
                    rest.append(None)
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                chosen = h % np.uint64(anchors) == 0
                first.append(h[chosen].view(np.int64))
                rest.append(h[~chosen][:max(0, p - int(chosen.sum()))].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(keys, pa.binary()), pa.array(list(map(short_key, keys)), pa.int64()), pa.array(sizes, pa.int64()),
                 b.column(3), pa.array(first, pa.list_(pa.int64())), pa.array(rest, pa.list_(pa.int64()))],
                names=["id", "pick", "f", "s", "n", "bytes", "first", "rest"])
    return run


def prefixes(rows: DataFrame, percent: int) -> DataFrame:
    """(s, token, place, first, size_class): the prefix shingles of every set that more than one row holds, in order; ``first``: also for sets
    that aren't smaller."""
    n = F.col("n")
    p, i = n - F.ceil(n * percent / F.lit(100)) + 1, n - F.ceil(n * 2 * percent / F.lit(100 + percent)) + 1
    # A class is a hair wider than the share, so that rounding can't put sets that link two classes apart.
    classes = F.floor(F.ln(n) / F.lit(-math.log(percent / 100) * (1 + 1e-9))).cast("int") if percent < 100 else n.cast("int")
    some = rows.where("first IS NOT NULL").select("s", p.alias("p"), i.alias("i"), classes.alias("size_class"), "first", "rest").withColumn("m", F.size("first"))
    tokens = some.select("s", "p", "i", "size_class", "m", F.explode("first").alias("token"))
    count = tokens.groupBy("token").count().where("count > 1")
    shared = tokens.join(count, "token").groupBy("s").agg(
        *[F.max(c).alias(c) for c in ("p", "i", "size_class", "m")], F.array_sort(F.array_distinct(F.collect_list(F.struct("count", "token")))).alias("shared"))
    # A set's other anchors are its own: they come first, and leave so many places to the shared ones.
    shared = shared.withColumn("own", F.col("m") - F.size("shared"))
    chosen = F.slice("shared", F.lit(1), F.greatest(F.least(F.col("p") - F.col("own"), F.size("shared")), F.lit(0)).cast("int"))
    anchors = shared.select("s", "size_class", "i", "own", F.posexplode(F.transform(chosen, lambda x: x["token"])).alias("place", "token"))
    others = some.select("s", "size_class", "i", F.col("m").alias("own"), F.posexplode("rest").alias("place", "token"))
    return anchors.unionByName(others).select("s", "token", (F.col("own") + F.col("place")).alias("place"), (F.col("own") + F.col("place") < F.col("i")).alias("first"),
                                              "size_class").distinct()


def tied(prefix: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(s, token, place) of the prefix shingles that may be the first of a link, and edges (s, a) that hold their sets together."""
    held = cut(prefix.groupBy("token", "size_class").agg(F.min("s").alias("hub"), F.max("s").alias("z"), F.bool_or("first").alias("f")))
    up = held.select("token", (F.col("size_class") - 1).alias("size_class"), F.col("hub").alias("up"))
    down = held.where("f").select("token", (F.col("size_class") + 1).alias("size_class"), F.lit(True).alias("below"))
    at = ["token", "size_class"]
    open_ = cut(held.join(up, at, "left").join(down, at, "left").where("(f AND (hub <> z OR up IS NOT NULL)) OR below"))
    kept = cut(prefix.join(open_.select(*at, "hub"), at))
    edges = kept.select("s", F.col("hub").alias("a")).unionByName(open_.where("f AND up IS NOT NULL").select(F.col("hub").alias("s"), F.col("up").alias("a")))
    return kept.select("s", "token", "place"), edges.where("s <> a").distinct()


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits of the rows to fetch, as blobs."""
    bits = np.zeros(BITMAP, dtype=bool)
    for b in batches:
        bits[b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(BITMAP - 1)] = True
    rows = list(blobs(np.packbits(bits), part_number())) if bits.any() else []
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
                                      pa.array([r[2] for r in rows], pa.binary())], names=["blob", "part", "data"])


def _fetched(shared, k: int):
    """(set's key, text) of the marked rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).astype(bool) if len(shared.value) else np.zeros(BITMAP, dtype=bool)
        for b in batches:
            pick = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            left = b.filter(pa.array(bits[pick & np.uint64(BITMAP - 1)]))
            texts = left.column(0).cast(pa.large_binary())
            keys = [set_key(hashed(t.as_py(), k)) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), left.column(0).cast(pa.string())], names=["f", "text"])
    return run


# ---------------------------------------------------------------------------
# Inside a task: the join of one group, or of two blocks of it
# ---------------------------------------------------------------------------

def group_links(texts: list[bytes], k: int = SHINGLE, percent: int = PERCENT, side: np.ndarray | None = None,
                before: list[list[int]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of positions of ``texts`` whose sets link.

    ``side``: only pairs of different sides. ``before``: only pairs that have none of these numbers in common.
    """
    vocab: dict[bytes, int] = {}
    sets = [np.fromiter({vocab.setdefault(g, len(vocab)) for g in shingles(t, k)}, dtype=np.int64) for t in texts]
    held = np.bincount(np.concatenate(sets), minlength=len(vocab)) if sets else np.zeros(0, dtype=np.int64)
    rank = np.empty(len(vocab), dtype=np.int64)
    rank[np.argsort(held, kind="stable")] = np.arange(len(vocab))  # rare ones first
    size = np.array([len(s) for s in sets], dtype=np.int64)
    by_size = np.argsort(size, kind="stable")
    sets, size = [np.sort(rank[sets[i]]) for i in by_size], size[by_size]
    side = None if side is None else side[by_size]
    known = None if before is None else [frozenset(before[i]) for i in by_size]
    start = np.concatenate([[0], np.cumsum(size)])
    flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.int64)

    # Prefix index: (shingle, set, position), shingles in order, sets by size.
    p = np.array([prefix_size(int(n), percent) for n in size], dtype=np.int64)
    indexed = np.array([index_size(int(n), percent) if p[x] else 0 for x, n in enumerate(size)], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), indexed)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(indexed) - indexed, indexed)
    first = flat[start[owner] + place]
    by = np.lexsort((owner, first))
    first, owner, place = first[by], owner[by], place[by]
    at = np.searchsorted(first, np.arange(len(vocab) + 1))
    # Suffix filter: how many shingles of each set lie between pivots of the order.
    pivots = np.quantile(flat, np.linspace(0, 1, PARTS + 1)[1:-1]) if len(flat) else np.zeros(0)
    cell = np.repeat(np.arange(len(sets)), size) * PARTS + np.searchsorted(pivots, flat)
    parts = np.bincount(cell, minlength=len(sets) * PARTS).reshape(len(sets), PARTS)

    mark, found = np.zeros(len(vocab), dtype=bool), []
    for x in range(1, len(sets)):
        own, n = sets[x], int(size[x])
        least = int(np.searchsorted(size, -(-percent * n // 100)))  # length filter
        if not p[x] or least >= x:
            continue
        spans = [(i, a + np.searchsorted(owner[a:b], least), a + np.searchsorted(owner[a:b], x))
                 for i, (a, b) in enumerate(zip(at[own[:p[x]]], at[own[:p[x]] + 1], strict=True)) if b > a]
        spans = [s for s in spans if s[2] > s[1]]
        if not spans:
            continue
        y = np.concatenate([owner[a:b] for _, a, b in spans])
        j = np.concatenate([place[a:b] for _, a, b in spans])
        i = np.repeat([s[0] for s in spans], [s[2] - s[1] for s in spans])
        if side is not None:
            live = side[y] != side[x]
            y, j, i = y[live], j[live], i[live]
        by = np.argsort(y, kind="stable")  # by set, then by position in x
        y, j, i = y[by], j[by], i[by]
        head = np.flatnonzero(np.diff(y, prepend=-1))
        if not len(head):
            continue
        last, common = np.append(head[1:], len(y)) - 1, np.diff(np.append(head, len(y)))
        need = -(-percent * (n + size[y[head]]) // (100 + percent))
        live = common + np.minimum(n - i[last] - 1, size[y[last]] - j[last] - 1) >= need  # positional filter
        y, need = y[head][live], need[live]
        live = np.minimum(parts[y], parts[x]).sum(axis=1) >= need  # suffix filter
        y = y[live]
        if not len(y):
            continue
        mark[own] = True  # verification
        ends = np.cumsum(size[y])
        tokens = flat[np.repeat(start[y] - ends + size[y], size[y]) + np.arange(ends[-1])]
        both = np.add.reduceat(mark[tokens], ends - size[y], dtype=np.int64)
        mark[own] = False
        y = y[100 * both >= percent * (n + size[y] - both)]
        if known is not None and known[x]:
            y = y[[known[x].isdisjoint(known[z]) for z in y.tolist()]]
        found.append(np.stack([np.full(len(y), x), y]))
    pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), dtype=np.int64)
    return by_size[pairs[0]], by_size[pairs[1]]


class Roots:
    """Components of keys under links; a component's root is its smallest key."""

    def __init__(self) -> None:
        self.root: dict[bytes, bytes] = {}

    def find(self, x: bytes) -> bytes:
        root = self.root
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    def link(self, x: bytes, y: bytes) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.root[max(x, y)] = min(x, y)


def _joined(k: int, percent: int):
    """Of one group or pair of blocks, of each set that links: its key, the smallest key of its local component, the documents of linked sets."""
    def run(group: pa.Table) -> pa.Table:
        keys, i, j = group["f"].to_pylist(), group["i"][0].as_py(), group["j"][0].as_py()
        side = group["side"].to_numpy() if i != j else None
        before = None if group["token"][0].as_py() is None else group["before"].to_pylist()
        a, b = group_links([t.encode() for t in group["text"].to_pylist()], k, percent, side, before)
        copies = group["copies"].to_numpy()
        links = np.bincount(a, copies[b], len(keys)) + np.bincount(b, copies[a], len(keys))
        roots = Roots()
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            roots.link(keys[x], keys[y])
        some = np.flatnonzero(links)
        at = group.take(pa.array(some))
        return pa.table({"key": at["key"], "whole": pa.array([before is None] * len(some), pa.bool_()), "f": at["f"], "least": at["least"],
                         "to": pa.array([roots.find(keys[x]) for x in some], pa.binary()), "links": pa.array(links[some].astype(np.int64), pa.int64())})
    return run


def _settled(group: pa.Table) -> pa.Table:
    """(f, head, links) of the sets of one candidate group: the smallest id of the component, and the documents of linked sets."""
    roots, least, links = Roots(), {}, {}
    for f, to, i, n in zip(*(group[c].to_pylist() for c in ("f", "to", "least", "links")), strict=True):
        roots.link(f, to)
        least[f], links[f] = i, links.get(f, 0) + n
    head: dict[bytes, object] = {}
    for f, i in least.items():
        r = roots.find(f)
        head[r] = i if head.get(r) is None else head[r] if i is None else min(i, head[r])
    return pa.table({"f": pa.array(list(least), pa.binary()), "head": pa.array([head[roots.find(f)] for f in least], group.schema.field("least").type),
                     "links": pa.array(list(links.values()), pa.int64())})


# ---------------------------------------------------------------------------
# The join
# ---------------------------------------------------------------------------

def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): the smallest node of the component of every node that has an edge (a, b).

    Every round takes the least label among the neighbours, then jumps to that label's label. Each round is cut; the edges stay where
    they are.
    """
    both = cut(edges.select(F.col(a).alias("node"), F.col(b).alias("other")).unionByName(
        edges.select(F.col(b).alias("node"), F.col(a).alias("other"))).repartition("other"))
    labels = cut(both.groupBy(F.col("other").alias("node")).agg(F.min("node").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        heard = both.join(labels.select(F.col("node").alias("other"), "label"), "other").select("node", "label", F.lit(None).cast(labels.schema["label"].dataType).alias("was"))
        near = heard.unionByName(labels.withColumn("was", F.col("label"))).groupBy("node").agg(F.min("label").alias("label"), F.min("was").alias("was"))
        jump = near.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = cut(near.join(jump, "label", "left").select("node", F.coalesce("next", "label").alias("label"), "was"))
        if labels.where("label <> was").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")


def groups(sets: DataFrame, ties: DataFrame, edges: DataFrame, most_bytes: int) -> DataFrame:
    """(f, copies, least, pick, key, token, before, bytes): the sets of each candidate group; those of a group of over ``most_bytes`` under each
    of their prefix shingles instead, with the prefix shingles before it."""
    labels = components(edges, "s", "a").select(F.col("node").alias("s"), "label")
    cand = cut(sets.select("f", "s", "copies", "least", "pick", "bytes").join(labels, "s"))
    large = cut(cand.groupBy("label").agg(F.sum("bytes").alias("all")).where(F.col("all") > most_bytes).select("label"))
    whole = cand.withColumns({"key": F.col("label"), "token": F.lit(None).cast("bigint"), "before": F.lit(None).cast("array<bigint>")})
    columns = ["f", "copies", "least", "pick", "key", "token", "before", "bytes"]
    if large.isEmpty():
        return whole.select(*columns)
    split = cand.join(large, "label", "left_semi")
    order = ties.join(split.select("s").distinct(), "s", "left_semi").groupBy("s").agg(
        F.array_sort(F.collect_list(F.struct("place", "token"))).alias("o")).select("s", F.transform("o", lambda x: x["token"]).alias("o"))
    under = order.select("s", "o", F.posexplode("o").alias("at", "token")).select("s", "token", F.slice("o", F.lit(1), F.col("at")).alias("before"))
    by_token = split.join(under, "s").withColumn("key", F.col("token"))
    return whole.join(large, "label", "left_anti").select(*columns).unionByName(by_token.select(*columns))


def blocks(members: DataFrame, block_bytes: int) -> DataFrame:
    """``members`` in blocks of about ``block_bytes`` a group: a row (i, j, side) for each pair of blocks that a set's block is in."""
    keys = members.groupBy(F.col("key").alias("of"), F.col("token").alias("by")).agg(
        F.greatest(F.ceil(F.sum("bytes") / block_bytes), F.lit(1)).cast("int").alias("k"))
    dealt = members.join(keys, (F.col("key") == F.col("of")) & F.col("token").eqNullSafe(F.col("by"))).withColumn(
        "side", F.pmod(F.xxhash64("f"), F.col("k")).cast("int"))
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select(
        "key", "token", "before", "f", "copies", "least", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT,
                 anchors: int = ANCHORS, block_bytes: int = BLOCK_BYTES, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """(id_col, n_shingles, component_id, n_links) for every row: the size of its set, the smallest id that links reach from it, and the number
    of other documents that it links with."""
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(f"`{text_col}`").cast("string")
    named = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("t"), F.xxhash64(F.col(f"`{id_col}`"), text).alias("pick"),
                        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"))
    rows = cut(named.mapInArrow(_described(shingle, percent, anchors),
                                f"id {kind}, pick bigint, f binary, s bigint, n bigint, bytes bigint, first array<bigint>, rest array<bigint>"))
    # Sets, each once. s is half of the key: it ties sets to groups, in which they go by their whole key.
    sets = cut(rows.where("n > 0").groupBy("f").agg(
        F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.min("pick").alias("pick"), F.max("bytes").alias("bytes"), F.min("s").alias("s")))
    prefix = cut(prefixes(rows, percent))
    members = cut(groups(sets, *tied(prefix), most_blocks * block_bytes))
    wanted = docs.sparkSession.sparkContext.broadcast(united(cut(members.select("pick").mapInArrow(_marked, BLOB))))
    texts = named.select("t", "pick").mapInArrow(_fetched(wanted, shingle), "f binary, text string").dropDuplicates(["f"])
    met = cut(blocks(members, block_bytes).join(texts, "f").groupBy("key", "token", "i", "j").applyInArrow(
        _joined(shingle, percent), f"key bigint, whole boolean, f binary, least {kind}, to binary, links bigint"))
    linked = met.where("whole").drop("whole").groupBy("key").applyInArrow(_settled, f"f binary, head {kind}, links bigint")
    split = met.where("NOT whole")
    if not split.isEmpty():
        near = components(split.where("f <> to").select("f", "to").distinct(), "f", "to").withColumnRenamed("node", "f")
        near = cut(near.join(split.groupBy("f").agg(F.sum("links").alias("links"), F.min("least").alias("least")), "f", "left"))
        head = near.groupBy("label").agg(F.min("least").alias("head"))
        linked = linked.unionByName(near.join(head, "label").select("f", "head", F.coalesce("links", F.lit(0)).alias("links")))
    heads = cut(sets.select("f", "least", "copies").join(linked, "f", "left").select(
        "f", F.coalesce("head", "least").alias("least"), "copies", F.coalesce("links", F.lit(0)).alias("links")))
    total = rows.count()
    hot = F.broadcast(heads.where(F.col("copies") * HOT > total))
    full = rows.where("n > 0").select("id", "n", "f")
    rest = full.join(hot.select("f"), "f", "left_anti").join(heads, "f")
    empty = rows.where("n = 0").select("id", "n", F.col("id").alias("least"), F.lit(0).cast("long").alias("n_links"))
    out = full.join(hot, "f").unionByName(rest).select("id", "n", "least", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    return out.unionByName(empty).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"), "n_links")


def duckdb_sql(shingle: int = SHINGLE, percent: int = PERCENT) -> str:
    """The same result from ``documents``, every pair with a common shingle counted."""
    upper = "".join(map(chr, range(65, 91)))
    gram = " || ' ' || ".join(f"t[i + {j}]" for j in range(shingle))
    return f"""WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS t FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(t) >= {shingle} THEN list_distinct(list_transform(range(1, len(t) - {shingle - 2}), lambda i: {gram}))
  WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END AS g FROM w),
x AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM s),
link AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b USING (gram) WHERE a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
reach AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT link.b, reach.c FROM reach JOIN link ON link.a = reach.doc_id)
SELECT s.doc_id, CAST(any_value(len(g)) AS BIGINT) AS n_shingles, min(c) AS component_id,
  CAST((SELECT count(*) FROM link WHERE link.a = s.doc_id) AS BIGINT) AS n_links
FROM s JOIN reach USING (doc_id) GROUP BY s.doc_id"""
