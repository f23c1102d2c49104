"""Costs that must not grow with rules, path lengths, stack windows or folders."""

import contextlib
import io
import re
import time

from pyspark.sql import functions as F

from logsieve.operators import signals as S
from logsieve.plans.analyze import annotate, telling_lines
from logsieve.sources import files as FS


def test_classification_is_code_that_java_compiles(spark):
    """Java interprets methods of more than 8000 bytes for good."""
    lines = spark.range(9).select(F.lit("j").alias("job_id"), F.col("id").alias("line_no"), F.col("id").alias("idx"), F.col("id").cast("string").alias("value"))
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        telling_lines(annotate(lines)).explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", out.getvalue())]
    assert sizes and max(sizes) < 8000


def test_names_of_long_paths(spark):
    """A search that starts at every character of a path takes the square of its length."""
    paths = ["a.log", "/a.log", "x//b.log", "/x/k=v/b.c.log", "/x/k=/.log", "d/", "/p q/d e/f", "/x/=a=b/c", "", "/" + "n" * 400_000 + "/job_id=j/f.txt", None]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    start = time.time()
    got = [tuple(r) for r in df.select(FS.job_column(F.col("path"), "dir"), FS.file_stem(F.col("path"))).collect()]
    assert got == [("", "a"), ("", "a"), ("", "b"), ("v", "b.c"), ("", ".log"), ("d", ""), ("d e", "f"), ("a=b", "c"), ("", ""), ("j", "f"), (None, None)]
    assert time.time() - start < 20


def test_stack_probes_do_not_grow_with_the_window(spark):
    lines = [("j", i, f"\tat a.b{i}(" if i % 7 in (3, 4) or 40 <= i < 90 else "x") for i in range(1, 120)]
    classified = spark.createDataFrame(lines, "job_id string, idx bigint, value string")
    firsts = spark.createDataFrame([("j", f"l{i}", i) for i in range(1, 120, 3)] + [("k", "l", 1)], "job_id string, label string, first_idx bigint")
    for window in (1, 2, 3, 20, 50):
        want = {}
        for i in range(1, 120, 3):
            run = []
            for _, k, v in lines[i:i + window]:  # the lines after position i
                if v != "x":
                    run.append(v.strip())
                elif run:
                    break
            if run:
                want[("j", f"l{i}")] = "\n".join(run)
        assert {(r.job_id, r.label): r.stack_trace for r in S.stack_traces(classified, firsts, window).collect()} == want
        assert S._probes(firsts, window).count() <= 2 * firsts.count()


def test_listing_tasks_are_bounded_by_the_cores(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(FS, "TASK_FOLDERS", 1)
    cores = spark.sparkContext.defaultParallelism
    n = 6 * cores
    for i in range(n):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "a.log").write_text("x")
    found = FS.file_listing(spark, str(tmp_path))
    assert found.count() == n and found.rdd.getNumPartitions() <= 4 * cores + 1
