"""The pipeline: each stage against brute force on its own input, and the whole on the smallest tables."""

import zlib

import numpy as np
import pytest
from test_decontaminate import plain as plain_hits
from test_packing import ref
from test_pii import plain_base
from test_simhash import plain_components, plain_fingerprint

import corpus_pipeline as CP
from logsieve.llm import quality_classifier as QC

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    home, out = tmp_path_factory.mktemp("stages"), {}
    docs = out["documents"] = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in CP.STAGES:
        stage(spark, docs, SF).write.parquet(f"{home}/{name}")
        docs = out[name] = spark.read.parquet(f"{home}/{name}")
    return out


def rows(df):
    return [tuple(r) for r in sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id))]


def test_stages_are_the_dealt_ones(stages):
    assert [n for n, _ in CP.STAGES] == ["quality_classifier", "simhash_dedup", "decontamination", "pii", "packing"]
    for name, _ in CP.STAGES[:-1]:
        assert stages[name].dtypes == stages["documents"].dtypes


def test_quality(spark, stages):
    docs = stages["documents"]
    model = QC.fit(QC.training_rows(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    w, b = model
    want = [r for r in rows(docs) if w[QC.indicators((r[1] or "").encode())].sum() + b >= 0]
    assert rows(stages["quality_classifier"]) == want and len(want) < docs.count()


def test_dedup(stages):
    before = rows(stages["quality_classifier"])
    comp = {i: c for i, _, c in plain_components([(r[0], plain_fingerprint(r[1])) for r in before])}
    assert rows(stages["simhash_dedup"]) == [r for r in before if comp[r[0]] == r[0]]


def test_decontamination(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = []
    for r in rows(stages["simhash_dedup"]):
        n, hit, _ = plain_hits(r[1], items)
        if not (hit and 20 * hit >= n):
            want.append(r)
    assert rows(stages["decontamination"]) == want


def test_pii(stages):
    before, after = rows(stages["decontamination"]), rows(stages["pii"])
    assert [r[0] for r in before] == [r[0] for r in after]
    changed = 0
    for b, a in zip(before, after, strict=True):
        spans = plain_base(b[1])
        assert not plain_base(a[1]) and all(b[1][s:e] not in a[1] for _, s, e in spans)
        if not spans and a[1] != b[1]:
            changed += 1
        if not spans:
            assert a == b or a[4] == len(a[1])
        else:
            assert a[4] == len(a[1]) and a[2:4] == b[2:4]
    assert changed == 0  # clean documents stay as they are


def test_packing(stages):
    docs = {r[0]: r[1] for r in rows(stages["pii"])}
    by = {}
    for r in stages["packing"].collect():
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == set(docs)
    for i, pieces in by.items():
        whole, at = np.array(ref(docs[i]), dtype="<u4"), 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(whole[at:at + p.length].tobytes())
            at += p.length
        assert at == len(whole)


def test_run_equals_the_stages(spark, stages):
    key = lambda r: str((r.doc_id, r.start))
    pick = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(CP.run(spark, SF).select(*pick).collect(), key=key) == sorted(stages["packing"].select(*pick).collect(), key=key)


def test_dedup_keeps_one_row_of_repeated_and_null_ids(spark):
    t, u = "a b c d e f g", "p q r s t u v"
    df = spark.createDataFrame([(1, t, "x"), (1, t, "x"), (1, u, "y"), (None, u, "y"), (2, None, "z"), (3, "", "z"), (None, None, "z"), (9, "q w e r t y", "w")],
                               "doc_id long, text string, _key string")
    left = sorted(map(str, CP.near_duplicates(spark, df, SF).select("doc_id", "text", "_key").collect()))
    assert len(left) == 4 and sum("p q r" in x for x in left) == 1 and sum("a b c" in x for x in left) == 1


def test_stages_on_empty_documents(spark, stages, tmp_path):
    docs = stages["documents"].limit(0)
    for name, stage in CP.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() == 0


def test_stages_pass_clashing_columns(spark):
    t = "the cat and the dog sat on a mat. Write to a@b.org about it, and to nobody else at all."
    names = ["score", "predicted", "n_words", "n_hit", "items", "matches", "pii", "k", "head", "fp", "_key", "passing_0", "n chars", "id"]
    df = spark.createDataFrame([(1, t, *["x"] * len(names)), (2, None, *[None] * len(names))], ["doc_id", "text", *names])
    for name, stage in CP.STAGES[1:4]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns and out.count() == 2, name
        assert {r.score for r in out.collect()} == {"x", None}
    assert CP.quality(spark, df, SF).columns == df.columns
    assert "[EMAIL]" in [r.text for r in CP.personal_data(spark, df, SF).collect() if r.text][0]
