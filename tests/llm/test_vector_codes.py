"""Vector codes against brute force: plain loops over all entries."""

import hashlib
import math

import numpy as np
import pytest

from logsieve.llm import queries as Q
from logsieve.llm import vector_codes as VC

SF = "/root/testdata/sf0.001"
RNG = np.random.default_rng(3)


def plain(rows, entries=256, rounds=4, parts=4):
    """rows: (id, vector, label) -> sorted (id, code, error, label_error, digest); vectors of one dimension."""
    kept = [(i, [max(-2**24, min(2**24, math.floor(1024 * x))) for x in v], lab) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    w = len(kept[0][1]) // parts
    x = np.array([v for _, v, _ in kept], dtype=np.int64)
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    codes, error, books = [], np.zeros(len(kept), dtype=np.int64), []
    for p in range(parts):
        part = x[:, p * w:p * w + w]
        book = part[first].copy()
        near = lambda: ((part[:, None] - book[None]) ** 2).sum(2).argmin(1)  # noqa: B023, E731
        for _ in range(rounds):
            at = near()
            for e in range(len(book)):
                if (at == e).any():
                    s, n = part[at == e].sum(0), int((at == e).sum())
                    book[e] = [int(a) // n for a in s]
        at = near()
        codes.append(at)
        error += ((part - book[at]) ** 2).sum(1)
        books += book.reshape(-1).tolist()
    digest = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    total = {}
    for k, (_, _, lab) in enumerate(kept):
        total[lab] = total.get(lab, 0) + int(error[k])
    return sorted(((i, "".join(f"{c[k]:02x}" for c in codes), int(error[k]), total[lab], digest) for k, (i, _, lab) in enumerate(kept)), key=str)


def got(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=str)


SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab) for i, v, lab in rows], SCHEMA)


@pytest.mark.parametrize("entries,cell", [(256, 64), (16, 7), (3, 1000)])
def test_clusters(spark, entries, cell):
    centres = RNG.normal(0, 0.2, (12, 16))
    rows = [(int(i), np.float32(centres[i % 12] + RNG.normal(0, 0.05, 16)).tolist(), None if i % 7 == 0 else int(i % 3)) for i in RNG.permutation(900)]
    rows += [(2000 + k, rows[0][1], 1) for k in range(300)]
    assert got(VC.compress(frame(spark, rows).repartition(4), entries=entries, cell=cell)) == plain(rows, entries)


def test_cells_give_the_nearest_entry():
    for _ in range(20):
        w, spread = int(RNG.integers(1, 20)), int(RNG.integers(2, 400))
        book, x = (RNG.integers(-spread, spread, (n, w)) for n in (int(RNG.integers(1, 60)), 500))
        cells = VC.Cells(book, int(RNG.integers(1, 200)), most=int(RNG.integers(1, 400)))
        for _ in range(2):  # with new and with known cells
            at, d = cells.nearest(x)
            all_d = ((x[:, None] - book[None]) ** 2).sum(2)
            assert at.tolist() == all_d.argmin(1).tolist() and d.tolist() == all_d.min(1).tolist()


def test_dominated_entries_are_not_evaluated():
    book = np.array([[0, 0], [1000, 1000], [10, 10]])
    assert VC.Cells(book, 64).undominated(np.array([[0, 0], [15, 15]])).tolist() == [[True, False, True], [False, True, False]]


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    ok = [(i, [float(i), -0.5, 0.25, 1e-9], i % 2) for i in range(5)]
    rows = [*ok, (6, None, 0), (7, [1.0, None, 0.0, 0.0], 0), (8, [nan] * 4, 1), (9, [inf, 0.0, 0.0, 0.0], 1), (10, [0.0, -inf, 0.0, 0.0], None),
            (0, [9.0, 9.0, 9.0, 9.0], None), (None, [1.0, 2.0, 3.0, 4.0], None), (2, ok[2][1], 0), (11, [3e38, -3e38, 0.0, 0.0], 5)]
    assert got(VC.compress(frame(spark, rows))) == plain(rows)


def test_other_dimensions_keep_their_row(spark):
    rows = [(i, [float(i)] * 8, 0) for i in range(6)]
    want = plain(rows)
    odd = [(100, [1.0] * 4, 0), (101, [], 7)]
    out = got(VC.compress(frame(spark, rows + odd)))
    assert [r for r in out if r[0] < 100] == want
    assert sorted(r[:4] for r in out if r[0] >= 100) == [(100, None, None, want[0][3]), (101, None, None, None)]
    alone = got(VC.compress(frame(spark, [(1, [1.0, 2.0, 3.0], 0), (2, [1.0] * 4, 0)])))  # can't be cut in four
    assert [r[:4] for r in alone] == [(1, None, None, None), (2, None, None, None)]


def test_empty_table_and_clashing_columns(spark):
    assert VC.compress(frame(spark, [])).collect() == []
    rows = [(i, [float(i % 3)] * 4, i) for i in range(9)]
    df = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA + ", id string, v int, code string, n int")
    assert got(VC.compress(df)) == plain(rows)


def test_query_on_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    out = Q.op13_vector_codes(spark, SF)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert got(out) == plain(rows)
