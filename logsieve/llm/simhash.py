"""SimHash near-duplicate groups through vantage-point trees.

A document's fingerprint is the bit majority of the XXH64 values of its word shingles.
Fingerprints link at ``max_bits`` or fewer differing bits; a group is what links reach.

Method. Distinct fingerprints (their copies are aggregated first, so a text that a third of the
corpus shares is one row) are partitioned by Hamming distance to vantage points: a small top tree,
built on the driver from a bounded sample, sends every fingerprint to one shard, and by the
triangle bound also to the shards across each boundary that it lies within ``max_bits`` of. Every
pair within ``max_bits`` therefore meets in at least one shard. Inside a shard a local
vantage-point tree prunes in the same way down to small blocks, which are compared exactly. A
shard gives no pairs: it gives one edge per linked fingerprint to the smallest fingerprint of its
local group, so a group of g near copies costs g edges. Components of these edges are found by
minimum labels with pointer jumping; nothing but the sample and counts reaches the driver.

A region that vantage points cannot split (a dense ball: most of it lies at every boundary) is
not sent to one task. Its fingerprints are keyed by their 65 variants with at most one bit
flipped; two fingerprints within two bits share a variant, so grouping by variant gives the same
links with groups of at most 65 rows. (Only for ``max_bits`` up to 2; beyond it the region stays one shard.)

Defined results: null text counts as empty; a text without words has fingerprint zero and links
like any other; a text with fewer words than the shingle has one shingle, the whole word sequence.
Rows with equal ids are kept as they are. Null ids are kept, and ignored as component ids
(a component of null ids only has a null id). Other columns of the input are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.llm.common import cut, free_names

SEED = 42
SHINGLE = 3
MAX_BITS = 2
#: Distinct fingerprints aimed at per shard, sampled fingerprints per shard, and the most shards.
SHARD_SIZE = 4096
SAMPLE_PER_SHARD = 64
MAX_SHARDS = 65_536
#: Shingles hashed at a time, so that a very long text needs bounded memory.
HASH_SLICE = 65_536
#: Local blocks at most this large are compared exactly.
BLOCK = 512
#: A fingerprint with over one HOT-th of the rows is joined by broadcast; there are fewer than HOT.
HOT = 1000
#: Keys (16 bytes and little more each) that are broadcast at most.
MOST_KEYS = 1_000_000
#: A split that leaves more than this share of its node on both sides together isn't worth it.
WORST_GROWTH = 1.7


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of one UTF-8 text, unsigned."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    n, ones = len(words) - shingle + 1, np.zeros(64, dtype=np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for lo in range(0, n, HASH_SLICE):
        part = words[lo:lo + HASH_SLICE + shingle - 1]
        grams = map(join, zip(*(part[i:] for i in range(shingle)), strict=False)) if shingle > 1 else part
        h = np.array([digest(g, SEED) for g in grams], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the signed 64-bit fingerprint of every row, in one narrow pass."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.large_binary())
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(
        run, f"id {kind}, fp bigint")


# ---------------------------------------------------------------------------
# Vantage-point trees
# ---------------------------------------------------------------------------

def distance(a: np.ndarray, b: np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def best_split(sample: np.ndarray, bits: int, tries: int, rng: np.random.Generator):
    """(vantage, radius, growth) of the split that copies least, or None if all distances are equal.

    Inside is distance <= radius; fingerprints inside with distance > radius - bits go to both.
    """
    best = None
    for v in sample[rng.permutation(len(sample))[:tries]]:
        count = np.bincount(distance(sample, v), minlength=65).cumsum() / len(sample)
        for r in range(64):
            inside = count[r]
            if not 0.25 <= inside <= 0.75:
                continue
            both = inside - (count[r - bits] if r >= bits else 0.0)
            cost = max(inside, 1 - inside + both) + both
            if best is None or cost < best[0]:
                best = (cost, v, r, 1 + both)
    return best and best[1:]


def build_tree(sample: np.ndarray, shards: int, bits: int = MAX_BITS, tries: int = 24) -> list[tuple]:
    """The top tree as a list of (vantage, radius, inner, outer); a shard is ~number.

    Each element below is split until it holds its share of the sample. A shard marked dense
    couldn't be split: (None, shard number). Node 0 is the root.
    """
    rng, nodes, made = np.random.default_rng(SEED), [], [0]
    target = max(1, len(sample) // max(1, shards))

    def grow(part: np.ndarray) -> int:
        split = best_split(part, bits, tries, rng) if len(part) > 1.5 * target else None
        if split is None or split[2] > WORST_GROWTH:
            dense = len(part) > 8 * target
            made[0] += 1
            nodes.append((None, made[0] - 1, dense, 0))
            return len(nodes) - 1
        v, r, _ = split
        nodes.append(None)
        at, d = len(nodes) - 1, distance(part, v)
        nodes[at] = (v, r, grow(part[d <= r]), grow(part[d > r - bits]))
        return at

    grow(sample)
    return nodes


def route(nodes: list[tuple], fps: np.ndarray, bits: int = MAX_BITS) -> Iterator[tuple[int, bool, np.ndarray]]:
    """(shard, dense, positions) for every shard that some of ``fps`` belong to or border on."""
    todo = [(0, np.arange(len(fps)))]
    while todo:
        at, idx = todo.pop()
        if not len(idx):
            continue
        v, r, a, b = nodes[at]
        if v is None:
            yield r, a, idx
        else:
            d = distance(fps[idx], v)
            todo += [(a, idx[d <= r]), (b, idx[d > r - bits])]


def local_links(fps: np.ndarray, bits: int = MAX_BITS, block: int = BLOCK) -> np.ndarray:
    """The smallest linked fingerprint reachable inside ``fps`` (distinct, unsigned), for each."""
    root = np.arange(len(fps))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    rng, todo = np.random.default_rng(SEED), [np.arange(len(fps))]
    while todo:
        idx = todo.pop()
        if len(idx) > block:
            sample = fps[idx] if len(idx) <= 2048 else fps[idx[rng.permutation(len(idx))[:2048]]]
            split = best_split(sample, bits, 12, rng)
            if split is not None and split[2] <= WORST_GROWTH:
                d = distance(fps[idx], split[0])
                parts = [idx[d <= split[1]], idx[d > split[1] - bits]]
                if max(map(len, parts)) < len(idx):
                    todo += parts
                    continue
        own = fps[idx]
        for lo in range(0, len(idx), 256):  # the block's rows against its later rows, 256 at a time
            near = np.bitwise_count(own[lo:lo + 256, None] ^ own[None, lo:]) <= bits
            for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
                a, b = find(int(idx[lo + i])), find(int(idx[lo + j]))
                if a != b:
                    root[max(a, b)] = min(a, b)
    top = np.array([find(i) for i in range(len(fps))], dtype=np.int64)
    least = fps.copy()
    np.minimum.at(least, top, fps)
    return least[top]


def links(distinct: DataFrame, bits: int = MAX_BITS, shard_size: int = SHARD_SIZE) -> DataFrame:
    """(fp, to): edges whose connected components are those of all pairs within ``bits``.

    ``distinct``: one column ``fp``, no repeats; it is read three times (pass a cut frame).
    """
    n = distinct.count()
    shards = min(MAX_SHARDS, max(1, -(-n // shard_size)))
    want = shards * SAMPLE_PER_SHARD
    every = max(1, n // want)
    rows = (distinct.where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).limit(2 * want)
            if shards > 1 else distinct.limit(0))
    sample = np.array([r.fp for r in rows.collect()], dtype=np.int64).view(np.uint64)
    nodes = build_tree(np.sort(sample), shards, bits)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            fps = f["fp"].to_numpy(dtype=np.int64)
            for shard, dense, idx in route(nodes, fps.view(np.uint64), bits):
                if dense and bits <= 2:
                    flips = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])
                    for flip in flips:
                        yield pd.DataFrame({"shard": -1 - shard, "fp": fps[idx],
                                            "variant": (fps[idx].view(np.uint64) ^ flip).view(np.int64)})
                else:
                    yield pd.DataFrame({"shard": shard, "fp": fps[idx], "variant": 0})

    def local(f: pd.DataFrame) -> pd.DataFrame:
        fps = np.unique(f["fp"].to_numpy(dtype=np.int64).view(np.uint64))
        to = local_links(fps, bits)
        moved = to != fps
        return pd.DataFrame({"fp": fps[moved].view(np.int64), "to": to[moved].view(np.int64)})

    dealt = distinct.mapInPandas(deal, "shard int, fp bigint, variant bigint")
    edges = dealt.where("shard >= 0").groupBy("shard").applyInPandas(local, "fp bigint, to bigint")
    if any(node[0] is None and node[2] for node in nodes) and bits <= 2:
        groups = dealt.where("shard < 0").groupBy("variant").agg(F.collect_set("fp").alias("fps"))  # 65 at most
        dense = groups.where("size(fps) > 1").select(F.explode("fps").alias("fp"), F.array_min("fps").alias("to"))
        edges = edges.unionByName(dense.where("fp <> to"))
    return edges.distinct()


def connected(edges: DataFrame, a: str = "fp", b: str = "to") -> DataFrame:
    """(node, label): the smallest node of the component of every node that has an edge.

    Every round takes the least label among the neighbours, then jumps to the label's label, so
    rounds grow with the logarithm of a component's diameter. Each round is cut.
    """
    both = cut(edges.select(F.col(a).alias("node"), F.col(b).alias("other")).unionByName(
        edges.select(F.col(b).alias("node"), F.col(a).alias("other"))))
    labels = cut(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        heard = both.join(labels.select(F.col("node").alias("other"), "label"), "other").select("node", "label")
        near = heard.unionByName(labels).groupBy("node").agg(F.min("label").alias("label"))
        jump = near.select(F.col("node").alias("label"), F.col("label").alias("next"))
        found = cut(near.join(jump, "label", "left").select("node", F.coalesce("next", "label").alias("label")))
        changed = found.join(labels.withColumnRenamed("label", "was"), "node").where("label <> was").limit(1).count()
        labels = found
        if not changed:
            return labels


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one of the smallest id, then of the smallest text hash.

    Rows are told apart by (id, 64-bit text hash). The keys of the rows that go are anti-joined, and only the rows of keys that repeat are
    compared; keys are broadcast up to ``MOST_KEYS`` of them, so that texts are shuffled beyond that only.
    """
    key, h = free_names(["_key", "_h"], docs.columns)
    keyed = docs.withColumn(key, F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("h")))
    found = cut(near_duplicates(keyed, key, text_col, **how).select(F.col(key).alias("k"), F.col("component_id").alias("head")))
    named = docs.withColumn(h, F.xxhash64(F.col(f"`{text_col}`")))

    def keys(some: DataFrame) -> tuple[DataFrame, int]:
        some = cut(some.select(F.col("k.id").alias("key_id"), F.col("k.h").alias("key_h")))
        n = some.count()
        return F.broadcast(some) if n <= MOST_KEYS else some, n

    same = F.col(f"`{id_col}`").eqNullSafe(F.col("key_id")) & (F.col(h) == F.col("key_h"))
    gone, _ = keys(found.where("k <> head").distinct())
    left = named.join(gone, same, "left_anti")
    repeated, n = keys(found.where("k = head").groupBy("k").count().where("count > 1"))
    if n:
        left = left.join(repeated, same, "left_anti").unionByName(left.join(repeated, same, "left_semi").dropDuplicates([id_col, h]))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    bits: int = MAX_BITS, shard_size: int = SHARD_SIZE) -> DataFrame:
    """(id_col, fp, component_id) for every row: the smallest id its fingerprint reaches."""
    fps = cut(fingerprints(docs, id_col, text_col, shingle))
    own = cut(fps.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    rows = own.agg(F.sum("n")).first()[0] or 0
    edges = cut(links(own.select("fp"), bits, shard_size))
    if not edges.isEmpty():
        labels = connected(edges)
        linked = own.join(labels.withColumnRenamed("node", "fp"), "fp")
        heads = linked.groupBy("label").agg(F.min("least").alias("head"))
        moved = linked.join(heads, "label").select("fp", "head")
        own = cut(own.join(moved, "fp", "left").select("fp", F.coalesce("head", "least").alias("least"), "n"))
    # Fewer than HOT fingerprints can each hold one HOT-th of the rows: their rows are joined by broadcast,
    # and only the others, none of which is frequent, are shuffled.
    hot = F.broadcast(own.where(F.col("n") * HOT > rows).select("fp", "least"))
    rest = fps.join(hot.select("fp"), "fp", "left_anti").join(own.select("fp", "least"), "fp", "left")
    return fps.join(hot, "fp").unionByName(rest).select(
        F.col("id").alias(id_col), "fp", F.col("least").alias("component_id"))
