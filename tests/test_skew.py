"""A job that holds a third of all rows is spread over many tasks."""

import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from logsieve.checks.corpus import render_blocks, render_corpus, time_chunk

EVENTS = "/root/testdata/sf0.01/events.parquet"
pytestmark = pytest.mark.skipif(not os.path.exists(EVENTS), reason="test tables not present")


def _skewed(spark):
    """Events where every third user is folded into user 0 (a hot job)."""
    ev = spark.read.parquet(EVENTS)
    return ev.withColumn("user_id", F.when(F.col("user_id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id")))


def test_hot_job_is_cut_into_bounded_chunks(spark):
    ev = _skewed(spark)
    rows_per_chunk = 200
    blocks = render_blocks(ev).withColumn("_chunk", time_chunk(ev, rows_per_chunk))
    sizes = blocks.groupBy("job_id", "_chunk").count()
    hot = blocks.filter(F.col("job_id") == "job_0").count()
    total = blocks.count()
    assert hot > total / 4                                # the hot job really is hot
    biggest = sizes.agg(F.max("count")).first()[0]
    n_hot_chunks = sizes.filter(F.col("job_id") == "job_0").count()
    assert n_hot_chunks >= 10                             # spread over many window groups
    assert biggest < hot / 5                              # no group near the hot job's size


def test_hot_job_numbering_is_exact(spark):
    ev = _skewed(spark)
    got = render_corpus(ev, rows_per_chunk=200).filter(F.col("job_id") == "job_0")
    # Brute force: one window over the whole job (fine on this small fixture).
    w = Window.partitionBy("job_id").orderBy("ts", "event_id", "pos")
    exp = render_blocks(ev).filter(F.col("job_id") == "job_0").withColumn("line_no", F.row_number().over(w))
    a = got.select("line_no", "value")
    b = exp.select(F.col("line_no").cast("bigint"), "value")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
