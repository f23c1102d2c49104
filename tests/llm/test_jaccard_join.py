"""Jaccard join against brute force: sets by plain loops, links by all pairs."""

import numpy as np
import pytest

from logsieve.llm import jaccard_join as JJ
from logsieve.llm import queries as Q

SF = "/root/testdata/sf0.001"
RNG = np.random.default_rng(11)


def plain_set(text, k=3):
    ws = (text or "").encode().lower().split()
    return {tuple(ws[i:i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else {tuple(ws)} if ws else set()


def plain(rows, percent=90, k=3):
    """rows: (id, text) -> sorted (id, size, smallest id reachable, links)."""
    sets = [plain_set(t, k) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for x, (i, _) in enumerate(rows):
        r = find(x)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(i, least[r])
    return sorted(((i, len(s), least[find(x)], n) for x, ((i, _), s, n) in enumerate(zip(rows, sets, links))), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in df.collect()), key=str)


def words(n, of=10_000):
    return [f"w{x}" for x in RNG.integers(0, of, n)]


def near(ws, edits):
    ws = list(ws)
    for at in RNG.integers(0, len(ws), edits):
        ws[at] = f"e{RNG.integers(0, 1 << 40)}"
    return ws


def corpus():
    """Clusters of near copies of several sizes and edits, exact copies, shared passages, loners."""
    out, passage = [], words(60)
    for size, n, edits in ((2, 40, 1), (5, 80, 2), (60, 120, 2), (30, 300, 6), (4, 12, 0), (8, 30, 1)):
        base = words(n)
        out += [" ".join(near(base, RNG.integers(0, edits + 1))) for _ in range(size)]
    out += [" ".join(passage + words(int(n))) for n in RNG.integers(0, 30, 40)]
    out += [" ".join(words(int(n))) for n in RNG.integers(0, 40, 40)]
    out += [out[3]] * 7 + [out[10].upper()] + ["x y z " * 200, "x y z " * 100, "the " * 50]
    return [(int(i), t) for i, t in zip(RNG.permutation(len(out)), out)]


@pytest.mark.parametrize("block,most", [(1 << 20, 16), (2000, 1000), (1500, 2)])
def test_clusters_whole_in_blocks_and_by_shingle(spark, block, most):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(JJ.jaccard_join(df, block_bytes=block, most_blocks=most)) == plain(rows)


@pytest.mark.parametrize("percent,k", [(80, 3), (50, 2), (95, 5)])
def test_other_shares_and_shingles(spark, percent, k):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(JJ.jaccard_join(df, shingle=k, percent=percent, block_bytes=20_000)) == plain(rows, percent, k)


def test_edge_cases(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\f\r "), (4, "one"), (5, "ONE"), (6, "one two"), (7, "a b c a b c a b c"), (8, base), (8, base),
            (None, base), (9, base.upper()), (10, base + " extra"), (11, "é à " * 50), (12, "x" * 100_000),
            (13, " ".join(f"v{i}" for i in range(70_000))), (14, " ".join(f"v{i}" for i in range(70_000)) + " end"), (15, "a b c"), (16, "É É É"), (2, None)]
    df = spark.createDataFrame([(i, t, "c", 0, "d", b"") for i, t in rows],
                               "doc_id long, text string, f string, n int, component_id string, blob binary")
    assert got(JJ.jaccard_join(df)) == plain(rows)


def test_empty_table_and_no_links(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert JJ.jaccard_join(df).collect() == []
    assert JJ.jaccard_join(df).columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    df = spark.createDataFrame([("b", "one two three"), ("a", None)], "doc_id string, text string")
    assert got(JJ.jaccard_join(df)) == [("a", 0, "a", 0), ("b", 1, "b", 0)]


def test_filters_lose_no_link():
    texts = [t.encode() for _, t in corpus()]
    sets = [plain_set(t.decode()) for t in texts]
    want = {(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i]) >= 9 and sets[i] and sets[j]
            and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])}
    a, b = JJ.group_links(texts)
    assert {(max(x), min(x)) for x in zip(a.tolist(), b.tolist())} == want
    assert len(a) == len(want)  # once a pair
    side = np.arange(len(texts)) % 2
    a, b = JJ.group_links(texts, side=side, before=[[i % 3] for i in range(len(texts))])
    assert {(max(x), min(x)) for x in zip(a.tolist(), b.tolist())} == {(i, j) for i, j in want if side[i] != side[j] and i % 3 != j % 3}


def test_bitmaps_are_united_in_steps(spark):
    def run(batches):
        import pyarrow as pa
        for b in batches:
            for p in b.column(0).to_pylist():
                x = np.zeros(64, dtype=np.uint8)
                x[p % 64] = 1 + p % 2
                rows = list(JJ.blobs(x, p))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
                                                  pa.array([r[2] for r in rows], pa.binary())], names=["blob", "part", "data"])
    df = spark.range(130).mapInArrow(run, JJ.BLOB)
    assert JJ.united(df).tolist() == [1, 2] * 32
    assert JJ.united(df.where("part < 3")).tolist() == [1, 2, 1] + [0] * 61


def test_query_on_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(Q.op12_jaccard_join(spark, SF)) == plain(rows)
