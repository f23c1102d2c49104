"""Quality and toxicity: held-out accuracy, and the fits against plain computations."""

import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from logsieve.llm import quality_classifier as QC
from logsieve.llm import queries as Q
from logsieve.llm import toxicity as TX

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, score string, GRADE string"


def labels_of(spark, column):
    return {r.doc_id: r[column] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def test_quality_on_held_out_rows(spark):
    rows = Q.op5_quality_classifier(spark, SF).collect()
    y = labels_of(spark, "quality")
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r.predicted == y[r.doc_id] for r in rows if r.held_out and r.doc_id in y]
    assert len(held) > 100 and np.mean(held) > 0.97


def test_indicators_do_not_depend_on_slices(monkeypatch):
    text = ("Some words, here!\nMORE || *** 12 é " * 50).encode()
    whole = QC.indicators(text)
    assert len(QC.indicators(b"")) == 0 and len(QC.indicators(None)) == 0
    assert whole.max() < QC.N_FEATURES and (np.diff(whole) > 0).all()


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 40, 8)) for _ in range(300)]
    y = np.array([1.0 if (r < 20).sum() * 2 > len(r) else -1.0 for r in rows])
    ratios = QC.log_count_ratios(rows, y, 40)
    w, b = QC.dual_coordinate_descent(rows, y, ratios, c=10, rounds=300)
    margin = np.array([w[r] @ ratios[r] + b for r in rows])
    assert ((margin > 0) == (y > 0)).mean() > 0.95
    primal = 0.5 * (w @ w + b * b) + 10 * np.maximum(0, 1 - y * margin).sum()
    assert primal < 0.5 * 10 * len(rows)  # much better than all-zero weights


def test_quality_edge_cases(spark):
    texts = [None, "", "word " * 100_000, "the cat sat on a mat", "!!! *** |||"]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)] + [(None, "a", "x", "y")], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = QC.score(docs, QC.fit(QC.training_rows(docs, none)))
    assert out.columns == ["doc_id", "text", "GRADE", "score", "predicted"] and {r.score for r in out.collect()} == {0.5}
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    one = spark.createDataFrame([(ids[0], 1), (ids[0], 1), (None, 0)], none.schema)
    assert {r.score for r in QC.score(docs, QC.fit(QC.training_rows(docs, one))).collect()} <= {0.5, 1.0}
    both = spark.createDataFrame([(i, int(i % 2)) for i in ids] + [(ids[0], None)], none.schema)
    train = spark.createDataFrame([(i, "good words. Here they are." if i % 2 else "BAD!! BAD!! BAD!!", "x", "y") for i in ids], DOCS)
    model = QC.fit(QC.training_rows(train, both))
    got = {r.text: r.predicted for r in QC.score(train, model).collect()}
    assert got == {"good words. Here they are.": 1, "BAD!! BAD!! BAD!!": 0}
    assert len(QC.score(docs, model).collect()) == 6 and QC.score(docs.limit(0), model).collect() == []
    assert QC.training_rows(train, both, max_rows=10).count() <= 10


def test_toxicity_on_table(spark):
    rows = Q.op7_toxicity(spark, SF).collect()
    y = labels_of(spark, "toxic")
    assert len(rows) == 1000
    pairs = [(r.toxic, y[r.doc_id]) for r in rows if r.doc_id in y]
    assert np.mean([a == b for a, b in pairs]) > 0.93
    assert sum(a and not b for a, b in pairs) <= 0.01 * len(pairs)  # clean ones are left alone
    assert all(0 <= r.expected_severity <= TX.GRADES and r.grade in range(4) for r in rows)


FAMILIES = "loser moron scum trash clown idiot worthless disgusting pathetic stupid".split()


def test_toxic_rows_with_a_family_are_found(spark):
    y, texts = labels_of(spark, "toxic"), {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [r for r in Q.op7_toxicity(spark, SF).collect() if y.get(r.doc_id)]
    held = [r for r in rows if set(FAMILIES) & set(TX.words(texts[r.doc_id]))]
    assert len(held) > 20 and np.mean([r.toxic for r in held]) >= 0.95
    assert {r.grade for r in rows} == {0, 1, 2, 3}  # 0: no family at all


def test_a_small_table_has_features_too(spark):
    small = "/root/testdata/sf0.001"
    y = {r.doc_id: r.toxic for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    rows = [(r.toxic, y[r.doc_id]) for r in Q.op7_toxicity(spark, small).collect() if r.doc_id in y]
    assert sum(a and b for a, b in rows) >= 5 and not any(a and not b for a, b in rows)


def test_a_rare_term_is_found(spark):
    rows = spark.range(8000).select(F.col("id").alias("doc_id"), (F.col("id") % 8 == 0).cast("int").alias("toxic"), F.concat(
        F.lit("so it goes on and on "), F.when(F.col("id") % 8 == 0, F.when(F.col("id") < 6400, "you zzyx").when(F.col("id") < 6480, "you rareword"))
        .otherwise("you there"), F.lit(" w"), (F.col("id") % 97).cast("string")).alias("text"))
    model = TX.fit(TX.training_rows(rows, rows.select("doc_id", "toxic")), 0.125)
    assert {"zzyx", "rareword"} <= set(model.names) and "you" not in model.names  # 800 and 10 of 1000 toxic rows
    judged = TX.severity(spark.createDataFrame([("a rareword here",), ("a word here",)], "text string"), model).collect()
    assert [r.toxic for r in judged] == [1, 0]


def test_chance_and_thirds():
    assert math.isclose(TX.by_chance(5, 0, 11, 76), math.comb(11, 5) / math.comb(87, 5))
    assert math.isclose(TX.by_chance(2, 3, 4, 6), sum(math.comb(4, k) * math.comb(6, 5 - k) for k in (2, 3, 4)) / math.comb(10, 5))
    assert TX.by_chance(0, 3, 4, 6) == 1 or math.isclose(TX.by_chance(0, 3, 4, 6), 1)
    for e in ([1, 1, 1, 1, 1, 2, 3], [1, 2, 3], [5] * 9 + [6, 7], list(range(30))):
        e = np.array(e, dtype=float)
        assert set((e[:, None] > TX.thirds(e)[None]).sum(axis=1)) == {0, 1, 2}


def test_ordinal_gradient_and_order():
    rng = np.random.default_rng(1)
    z = rng.normal(0, 2, 600)
    y = np.digitize(z + rng.logistic(0, 0.3, 600), [-1.0, 0.5, 2.0])
    model = TX.Ordinal(["a"])
    model.fit([(np.array([0]), np.array([v])) for v in z], y, share=(y > 0).mean(), rounds=1500)
    t = model.thresholds / model.w[0]
    assert (np.diff(t) > 0).all() and np.allclose(t, [-1.0, 0.5, 2.0], atol=0.25)
    up = model.above(np.array([0.0, 1.0]))
    assert (np.diff(up, axis=1) < 0).all() and math.isclose(up[0, 0], 1 / (1 + math.exp(model.thresholds[0])))


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "x", "y"), (2, "", "x", "y"), (2, "word " * 50_000, "x", "y"), (None, "a", "x", "y")], DOCS)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = TX.severity(docs, TX.fit(TX.training_rows(docs, none), TX.toxic_share(none)))
    assert out.columns == ["doc_id", "text", "score", *TX.ADDED] and {r.expected_severity for r in out.collect()} == {0.0}
    train = spark.range(200).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, F.concat(F.lit("you awful"), F.repeat(F.lit(" awful"), (F.col("id") % 3).cast("int"))))
                                    .otherwise("fine words only").alias("text"))
    labels = train.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    model = TX.fit(TX.training_rows(train, labels), TX.toxic_share(labels))
    got = {(r.text.count("awful"), r.toxic) for r in TX.severity(train, model).collect()}
    assert got == {(0, 0), (1, 1), (2, 1), (3, 1)}
    by = {r.text.count("awful"): r.expected_severity for r in TX.severity(train, model).collect()}
    assert by[0] < by[1] < by[2] < by[3]
    assert len(TX.severity(docs, model).collect()) == 4 and TX.severity(docs.limit(0), model).collect() == []
