"""SimHash groups against brute force: fingerprints by plain loops, links by all pairs."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from logsieve.llm import queries as Q
from logsieve.llm import simhash as SH

SF = "/root/testdata/sf0.001"
RNG = np.random.default_rng(7)


def plain_fingerprint(text, k=3):
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    grams = [b" ".join(ws[i:i + k]) for i in range(len(ws) - k + 1)] if len(ws) >= k else [b" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(rows, bits=2):
    """rows: (id, fp) -> sorted (id, fp, smallest id reachable)."""
    fps = sorted({fp for _, fp in rows})
    root = {fp: fp for fp in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    arr = np.array(fps, dtype=np.uint64)
    for i, fp in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1:] ^ np.uint64(fp)) <= bits) + i + 1:
            a, b = find(fp), find(fps[j])
            if a != b:
                root[max(a, b)] = min(a, b)
    least = {}
    for i, fp in rows:
        r = find(fp)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(i, least[r])
    return sorted(((i, fp, least[find(fp)]) for i, fp in rows), key=str)


def got(df):
    return sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in df.collect()), key=str)


def test_edge_cases(spark):
    base = " ".join(f"w{i}" for i in range(40))
    texts = [(1, None), (2, ""), (3, " \t\n\x0b\f\r "), (4, "one"), (5, "ONE"), (6, "one two"), (7, "a b c a b c a b c"),
             (8, base), (8, base), (None, base), (9, base.upper()), (10, base + " extra"), (11, "é à " * 50),
             (12, "x" * 100_000), (13, "word " * 70_000 + "end"), (14, "a b c"), (15, "É É É")]
    df = spark.createDataFrame([(i, t, "c", "d", 0) for i, t in texts],
                               "doc_id long, text string, fp string, component_id string, id int")
    rows = [(i, plain_fingerprint(t)) for i, t in texts]
    assert got(SH.near_duplicates(df)) == plain_components(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert SH.near_duplicates(df).collect() == []
    assert SH.near_duplicates(df).columns == ["doc_id", "fp", "component_id"]


def test_null_ids_only(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "a b c d")], "doc_id long, text string")
    assert [r.component_id for r in SH.near_duplicates(df).collect()] == [None, None]


def clusters(n, spread, size):
    """n random centres, each with ``size`` members a few flips away, and as many loners."""
    out = list(RNG.integers(0, 1 << 63, n, dtype=np.uint64))
    for c in out[:n]:
        for _ in range(size):
            x = int(c)
            for b in RNG.integers(0, 64, RNG.integers(0, spread + 1)):
                x ^= 1 << int(b)
            out.append(x)
    return sorted({int(x) for x in out})


@pytest.mark.parametrize("fps,shard", [(clusters(1500, 3, 1), 64), (clusters(3, 4, 900), 32), (clusters(1, 6, 3000), 100),
                                       ([*range(3000)], 50)])
def test_links_keep_components(spark, fps, shard):
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    d = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = SH.links(d, 2, shard)
    flat = np.array([(r.fp, r.to) for r in edges.collect()], dtype=np.int64).reshape(-1, 2)
    rows = [(x, int(np.int64(x).view(np.uint64))) for x in signed]
    want = {i: c for i, _, c in plain_components(rows)}
    assert all(want[a] == want[b] for a, b in flat.tolist())
    assert len(flat) < 70 * len(fps)  # no pairs: stars only
    lab = {r.node: r.label for r in SH.connected(edges).collect()} if len(flat) else {}
    mine = {}
    for x in signed:
        mine.setdefault(lab.get(x, x), set()).add(x)
    theirs = {}
    for x in signed:
        theirs.setdefault(want[x], set()).add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_long_chain_converges(spark):
    e = spark.range(200).select(F.col("id").alias("fp"), (F.col("id") + 1).alias("to"))
    assert {r.label for r in SH.connected(e).collect()} == {0}


@pytest.mark.parametrize("n", [5, 700, 3000])
def test_local_links_exact(n):
    fps = np.array(clusters(max(1, n // 20), 3, 19), dtype=np.uint64)
    to = SH.local_links(fps, 2, block=64)
    want = {fp: c for fp, _, c in plain_components([(int(x), int(x)) for x in fps])}
    assert to.tolist() == [want[int(x)] for x in fps]


def test_query_on_table(spark):
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = Q.op9_simhash_dedup(spark, SF)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    mine = sorted(((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in out.collect()), key=str)
    assert mine == plain_components(rows)
    assert all(len(r.fingerprint) == 16 for r in out.collect())
