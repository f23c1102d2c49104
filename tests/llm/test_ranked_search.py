"""Ranked search against brute force: every document scored by plain integer loops."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from logsieve.llm import queries as Q
from logsieve.llm import ranked_search as RS

SF = "/root/testdata/sf0.001"
RNG = np.random.default_rng(5)
TERM = re.compile(RS.TERM_PATTERN)


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, top=10):
    bags = [(i, Counter(ts), len(ts)) for i, ts in ((i, plain_terms(t)) for i, t in docs)]
    n_docs, n_terms = sum(n > 0 for _, _, n in bags), sum(n for _, _, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in items:
        scored = []
        for i, bag, n in bags:
            m = 100 - 75 + 75 * n * n_docs // n_terms if n_terms else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * bag[t] // (1000 * bag[t] + 8 * m))
                    for t in plain_terms(text) if bag[t])
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


def zipf_text(n):
    return " ".join(f"t{min(x, 3000)}" for x in RNG.zipf(1.3, n))


@pytest.mark.parametrize("postings,block", [(1 << 21, 10**6), (500, 40), (1, 1)])
def test_many_documents(spark, postings, block):
    docs = [(int(i), zipf_text(int(n))) for i, n in zip(RNG.permutation(1500), RNG.integers(0, 60, 1500))]
    items = [(k, zipf_text(int(n))) for k, n in enumerate(RNG.integers(0, 25, 6 if block == 1 else 20))]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    assert got(RS.search(d, i, shard_postings=postings, block_terms=block)) == plain(docs, items)


@pytest.mark.parametrize("short,first", [(8, 512), (10**9, 1), (10**9, 16), (1, 4)])
def test_iterators_give_the_best(short, first):
    for _ in range(30):
        n = int(RNG.integers(1, 400))
        lists = []
        for _ in range(int(RNG.integers(1, 8))):
            d = np.flatnonzero(RNG.random(n) < RNG.random())
            if len(d):
                lists.append((d, RNG.integers(0, 50, len(d))))
        total = np.zeros(n, dtype=np.int64)
        for d, s in lists:
            total[d] += s
        want = np.lexsort((np.arange(n), -total))[:10]
        want = want[total[want] > 0]
        docs, scores = RS.best_of(lists, n, 10, 1, short, first)
        assert docs.tolist() == want.tolist() and scores.tolist() == total[want].tolist()


def test_edge_cases(spark):
    docs = [(1, None), (2, ""), (3, "--- !!"), (4, "Apple apple PEAR"), (4, "Apple apple PEAR"), (None, "apple apple pear"), (5, "é É apple"),
            (6, "x" * 100_000), (7, "apple " * 50_000), (8, "pear\x00plum"), (9, "apple")]
    items = [("a", "apple"), ("b", None), ("c", ""), ("d", "nothing here"), (None, "pear pear PLUM"), ("a", "É"), ("e", "x" * 100_000)]
    d = spark.createDataFrame([(i, t, 0, "s", 1) for i, t in docs], "doc_id long, text string, score int, item_id string, rank int")
    i = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id string, text string, doc_id int")
    assert got(RS.search(d, i)) == plain(docs, items)


def test_every_document_has_the_term(spark):
    docs = [(i, "same") for i in range(30)]  # df = N: the weight may be 0, then nothing is found
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(1, "same")], "item_id long, text string")
    assert got(RS.search(d, i)) == plain(docs, [(1, "same")])


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert RS.search(none, some).collect() == []
    assert RS.search(none, some).columns == ["item_id", "rank", "doc_id", "score"]
    assert RS.search(some.withColumnRenamed("item_id", "doc_id"), none.withColumnRenamed("doc_id", "item_id")).collect() == []


def test_query_on_table(spark):
    rows = lambda t, k: [(r[k], r.text) for r in spark.read.parquet(f"{SF}/{t}.parquet").collect()]
    assert got(Q.op11_ranked_search(spark, SF)) == plain(rows("documents", "doc_id"), rows("benchmark", "item_id"))
