"""Packing: exact round trip to the tokenizer's ids, no overlap, no gap, next to no padding."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from logsieve.llm import packing as PK
from logsieve.llm import queries as Q

SF = "/root/testdata/sf0.01"
FILES = Q.tokenizer_files()
REF = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
TEXT_ONLY = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
TEXT_ONLY.encode_special_tokens = True


def ref(text, tokenizer=REF):
    return [*(tokenizer.encode(text, add_special_tokens=False).ids if text else ()), 1]


def unpack(rows):
    docs, seqs = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048
    return docs, {k: sum(r.length for r in v) for k, v in seqs.items()}


def test_round_trip(spark):
    rng = random.Random(1)
    texts = ["", None, "a", "x" * 3000, "Hello, it's  me\n\n  12 + 3", "日本語 текст 🙂 ﬁ", "<|endoftext|> a", "word " * 30_000,
             "   b\u0085c", "a" * 399 + " b"] + [" ".join(rng.choice(["alpha", "été", "9", "!?"]) for _ in range(n))
                                                      for n in (1, 5, 100, 2000, 5000)]
    df = spark.createDataFrame([(i, t, "s", 3) for i, t in enumerate(texts)], "doc_id long, text string, ids string, start int")
    rows = PK.pack(df.repartition(3), **FILES).collect()
    docs, sizes = unpack(rows)
    for i, t in enumerate(texts):
        whole = ref(t)
        pieces = sorted(docs[i], key=lambda r: r.start)
        assert [x for r in pieces for x in np.frombuffer(bytes(r.ids), "<u4").tolist()] == whole
        assert np.cumsum([0, *[r.length for r in pieces]]).tolist()[:-1] == [r.start for r in pieces]
        assert {r.doc_tokens for r in pieces} == {len(whole)}
    assert all(n & (n - 1) == 0 for n in sizes.values())


def filled(lengths, capacity=2048, **how):
    """The sequences of documents of these lengths: lists of (document, start, length)."""
    bins, seqs = PK.Bins(0, capacity, **how), {}
    ids = [np.arange(n, dtype="<u4") + 1000 * d for d, n in enumerate(lengths)]

    def take(pieces):
        for d, start, k, data, tokens, seq, off in pieces:
            assert np.frombuffer(data, "<u4").tolist() == ids[d][start:start + k].tolist() and tokens == len(ids[d])
            seqs.setdefault(seq, []).append((d, start, k, off))

    for d, x in enumerate(ids):
        take(bins.put(d, x))
    settled = len(seqs)
    take(bins.end())
    got = {}
    for pieces in seqs.values():
        assert [p[3] for p in pieces] == np.cumsum([0, *[p[2] for p in pieces]])[:-1].tolist()
        for d, start, k, _ in pieces:
            got.setdefault(d, []).append((start, k))
    for d, n in enumerate(lengths):
        at = 0
        for start, k in sorted(got.get(d, [])):
            assert start == at and k > 0
            at += k
        assert at == n
    return list(seqs.values()), settled


def test_classes_take_a_fixed_count_uncut():
    seqs, settled = filled([300] * 6 + [248, 2048] + [30] * 69, classes=64)
    assert settled == 3
    assert [p[:3] for p in seqs[0]] == [(d, 0, 300) for d in range(6)] + [(6, 0, 248)]  # class 6: six rests, then what it lacks
    assert [p[:3] for p in seqs[1]] == [(7, 0, 2048)]
    assert [p[:3] for p in seqs[2]] == [(d, 0, 30) for d in range(8, 76)] + [(76, 0, 8)]  # the last class takes the shorter ones too


@pytest.mark.parametrize("smallest", [1, 16, 64])
def test_little_padding_and_few_cuts(smallest):
    rng = np.random.default_rng(smallest)
    lengths = np.concatenate([rng.integers(1, 3000, 3000), rng.integers(1, 40, 1000), [1] * 500])
    rng.shuffle(lengths)
    seqs, _ = filled(lengths.tolist(), smallest=smallest)
    sizes = [sum(p[2] for p in s) for s in seqs]
    assert max(sizes) <= 2048
    padding = sum(2048 - n for n in sizes if n & (n - 1))
    assert padding == 0 if smallest == 1 else padding < 0.01 * sum(sizes)
    pieces = sum(map(len, seqs))
    assert pieces < len(lengths) + 2.2 * len(seqs)
    assert not any(len(s) > 32 and all(p[2] == 1 for p in s) for s in seqs)
    assert sum(n < 2048 and n & (n - 1) == 0 for n in sizes) <= 11


def test_control_strings_are_a_choice(spark):
    text = "a <|endoftext|> b"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    for how, tokenizer in ((False, REF), (True, TEXT_ONLY)):
        rows = PK.pack(df, control_as_text=how, **FILES).collect()
        ids = [x for r in sorted(rows, key=lambda r: r.start) for x in np.frombuffer(bytes(r.ids), "<u4").tolist()]
        assert ids == ref(text, tokenizer)
    assert len(ref(text)) < len(ref(text, TEXT_ONLY))


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    rows = PK.pack(df, **FILES).collect()
    assert sorted((str(r.doc_id), r.doc_tokens) for r in rows if r.start == 0) == [("1", 3), ("1", 3), ("None", 2)]


def test_empty_table(spark):
    assert PK.pack(spark.createDataFrame([], "doc_id long, text string"), **FILES).collect() == []


def test_bad_capacity(spark):
    with pytest.raises(ValueError):
        PK.pack(spark.createDataFrame([], "doc_id long, text string"), capacity=1000, **FILES)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet=" \t\n\r 'sStTaéß0²½_-.!‐…­", max_size=60))
def test_fast_path_gives_the_same_ids(text):
    if not hasattr(test_fast_path_gives_the_same_ids, "encode"):
        test_fast_path_gives_the_same_ids.encode = PK.encoder(**FILES)
    assert [*test_fast_path_gives_the_same_ids.encode(text), 1] == ref(text) or not text


def test_query_on_table(spark):
    out = Q.op2_packing(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    docs, sizes = unpack(out.collect())
    table = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(docs) == len(table)
    for r in table[::5]:
        whole, at = np.array(ref(r.text), dtype="<u4"), 0
        for p in sorted(docs[r.doc_id], key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(whole[at:at + p.length].tobytes())
            at += p.length
        assert at == len(whole) == p.doc_tokens
    padded = sum(2048 - n for n in sizes.values() if n & (n - 1))
    assert padded == 0
