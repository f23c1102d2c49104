"""Contamination against brute force, and the longest matches against plain search."""

import hashlib
import random
import re

from logsieve.llm import decontaminate as DC
from logsieve.llm import queries as Q

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(text, items, window=13):
    ws = plain_words(text)
    places = {}
    for i, w in enumerate(ws):
        places.setdefault(w, []).append(i)
    hit, ids = set(), set()
    for item_id, item in items:
        iw = plain_words(item)
        n = min(window, len(iw))
        for s in range(len(iw) - n + 1) if n else ():
            for p in places.get(iw[s], ()):
                if ws[p:p + n] == iw[s:s + n]:
                    hit.update(range(p, p + n))
                    ids.add("" if item_id is None else str(item_id))
    return len(ws), len(hit), sorted(ids)


def rows_of(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string, N_HIT string, items int, _state string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return d, b, DC.decontaminate(d, b, **kw).collect()


def check(spark, texts, items, **kw):
    docs = [(i, t, "x", 1, "s") for i, t in enumerate(texts)]
    _, _, rows = rows_of(spark, docs, items, **kw)
    by = {r.doc_id: r for r in rows}
    assert len(by) == len(texts)
    for i, t in enumerate(texts):
        assert (by[i].n_words, by[i].n_hit, by[i]["items"]) == plain(t, items, kw.get("window", 13)), (i, t)
    return by


def made_up(rng, vocab, n):
    return " ".join(rng.choice(vocab) for _ in range(n))


def test_random_texts_all_window_sizes(spark):
    rng = random.Random(3)
    vocab = ["a", "b", "the", "né", "x9", "Ω"]
    items = [(i, made_up(rng, vocab, n)) for i, n in enumerate([1, 2, 3, 4, 5, 7, 13, 14, 30, 0])]
    items += [(3, "the the"), (None, "zz zz2"), (77, None), (78, "")]
    texts = [made_up(rng, vocab, n) for n in (0, 1, 2, 3, 10, 60, 200)] + ["zz, ZZ2!", None, "", "..."]
    for window in (13, 4, 2, 1):
        for block in (1_000_000, 9):
            check(spark, texts, items, window=window, block_words=block)


def test_longest_match_and_places(spark):
    item = " ".join(f"i{k}" for k in range(30))
    ws = item.split()
    text = "p q " + " ".join(ws[5:25]) + " r " + " ".join(ws[0:13]) + " s " + " ".join(ws[0:12])
    by = check(spark, [text, text * 2], [(4, item)])
    assert [tuple(m) for m in by[0].matches] == [("4", 2, 5, 20), ("4", 23, 0, 13)]


def test_joined_texts_do_not_match_across_documents(spark):
    ws = [f"i{k}" for k in range(13)]
    check(spark, [" ".join(ws[:6]), " ".join(ws[6:]), " ".join(ws)], [(1, " ".join(ws))])


def test_extra_columns_and_clashes(spark):
    d, b, rows = rows_of(spark, [(1, "a b", "keep me", 1, "s")], [(1, "a")])
    assert rows[0]["_state"] == "s" and rows[0].n_hit == 1
    assert set(rows[0].asDict()) == {"doc_id", "text", "N_HIT", "_state", "n_words", "n_hit", "items", "matches"} - {"N_HIT"}


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert DC.decontaminate(d, b).collect() == []
    one = spark.createDataFrame([(1, "a b c")], d.schema)
    r = DC.decontaminate(one, b).collect()[0]
    assert (r.n_words, r.n_hit, r["items"], r.matches) == (3, 0, [], [])


def test_repeated_windows_and_items_cost_no_pairs(spark):
    """20,000 equal words against 200 equal short items, and a long text of one window that 200 items share."""
    import time
    import tracemalloc

    shared = " ".join(f"s{k}" for k in range(15))
    items = [(str(i), w, 0) for i, w in enumerate([[b"yes"]] * 200 + [shared.encode().split()] * 200)]
    index = DC.Index(items, 13)
    texts = [b"yes " * 20_000, ((shared + " x ") * 1500).encode(), b"no"]
    DC.scan_shard(index, texts[2:], False)
    tracemalloc.start()
    began = time.time()
    got = DC.scan_shard(index, texts, False)
    took, peak = time.time() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(n, sum(h["end"] - h["start"] for h in hits), len(ids)) for n, hits, ids, _ in got] == [(20_000, 20_000, 200), (24_000, 22_500, 200), (1, 0, 0)]
    assert took < 5 and peak < 100 << 20
    found = DC.scan_shard(index, texts, True)
    assert len(found[0][3]) == 20_000 and [tuple(m.values()) for m in found[1][3][:2]] == [("200", 0, 0, 15), ("200", 16, 0, 15)]


def test_shared_and_short_items_in_blocks(spark):
    rng = random.Random(8)
    vocab = ["a", "b", "c"]
    items = [(i % 7, made_up(rng, vocab, n)) for i, n in enumerate([1, 1, 2, 2, 3, 3, 5, 8, 13, 13, 16, 20])]
    items += [(50 + i, items[-1][1]) for i in range(5)] + [(60, None), (None, "a b")]
    texts = [made_up(rng, vocab, n) for n in (0, 1, 5, 50, 400)] + [items[-6][1], None]
    for block in (1_000_000, 30, 1):
        check(spark, texts, items, block_words=block)
    assert "matches" not in rows_of(spark, [(1, "a b", "x", 1, "s")], [(1, "a")], matches=False)[2][0].asDict()


def test_very_long_text(spark):
    item = " ".join(f"q{k}" for k in range(20))
    check(spark, ["filler " * 300_000 + item, "x" * 500_000], [(9, item)])


def test_query_on_table(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r.doc_id: r for r in Q.op10_decontamination(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    some = 0
    for r in docs:
        n, hit, ids = plain(r.text, items)
        g = got[r.doc_id]
        assert (g.n_words, g.n_hit, g.n_items) == (n, hit, len(ids))
        assert g.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()
        assert g.contaminated == (hit > 0 and 20 * hit >= n)
        some += g.contaminated
    assert some
