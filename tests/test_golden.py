"""Golden per-log results (FIXTURES.md section 2), text and file sources."""

import pytest
from pyspark.sql import functions as F

from logsieve import analyze, lines_from_text
from logsieve.sources.files import read_logs
from tests.fixtures import FILE_GOLDEN, GOLDEN, OOM_LOG as OOM_TEXT


def _check(row, exp):
    (n_lines, err, warn, version, platform, stages, lost, oom, shuffle, retries, sigs, frames) = exp
    c = row["job_context"]
    assert c["total_log_lines"] == n_lines
    assert c["error_count"] == err
    assert c["warn_count"] == warn
    assert c["spark_version"] == version
    assert c["platform"] == platform
    assert list(c["failed_stages"]) == stages
    assert c["executors_lost"] == lost
    assert c["oom_events"] == oom
    assert c["shuffle_failures"] == shuffle
    assert c["task_retries"] == retries
    got = [(s["label"], s["n"]) for s in row["all_signals"]]
    assert got == sigs
    got_frames = [0 if s["stack_trace"] is None else len(s["stack_trace"].split("\n"))
                  for s in row["all_signals"]]
    assert got_frames == frames
    if sigs:
        assert row["primary_signal"]["label"] == sigs[0][0]
        assert len(row["raw_error_snippet"]) > 0
    else:
        assert row["primary_signal"] is None
        assert row["raw_error_snippet"] == ""


@pytest.fixture(scope="module")
def text_analysis(spark):
    df = spark.createDataFrame([(g[0], g[1]) for g in GOLDEN], ["job_id", "text"])
    rows = analyze(lines_from_text(df), as_of="2024-01-01T00:00:00").collect()
    return {r["job_id"]: r for r in rows}


@pytest.mark.parametrize("g", GOLDEN, ids=[g[0] for g in GOLDEN])
def test_text_golden(text_analysis, g):
    _check(text_analysis[g[0]], g[2:])


def test_stack_of_oom_names_plan(text_analysis):
    assert "SparkPlan" in text_analysis["oom"]["primary_signal"]["stack_trace"]


def test_tail_is_last_nonblank_lines(text_analysis):
    r = text_analysis["multi"]
    assert r["log_tail"].split("\n")[-1].startswith("24/03/02 10:05:01 WARN")
    assert "" not in r["log_tail"].split("\n")


def test_file_golden(spark, data_dir):
    rows = analyze(read_logs(spark, data_dir, job="stem"), as_of="2024-01-01T00:00:00").collect()
    by = {r["job_id"]: r for r in rows}
    assert set(by) == set(FILE_GOLDEN)
    for job, exp in FILE_GOLDEN.items():
        _check(by[job], exp)


def test_file_numbering_many_splits(spark, data_dir):
    """Exact line numbers when each file is cut into many input splits."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.text(data_dir).rdd.getNumPartitions() > 3
        got = sorted((r.job_id, r.line_no, r.value) for r in read_logs(spark, data_dir, job="stem").collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    import os
    exp = []
    for f in os.listdir(data_dir):
        with open(os.path.join(data_dir, f)) as fh:
            for i, line in enumerate(fh.read().splitlines(), 1):
                exp.append((f[:-4], i, line))
    assert got == sorted(exp)


def test_error_subset_scope(spark, data_dir):
    """The Spark-path scope: first 150 error lines, version lost, stacks lost."""
    a = analyze(read_logs(spark, data_dir, job="stem"), as_of="t", scope="error_subset").filter(F.col("job_id") == "oom_sample")
    r = a.collect()[0]
    c = r["job_context"]
    assert c["total_log_lines"] == 19
    assert c["spark_version"] == "unknown"
    assert c["platform"] == "yarn"
    assert all(s["stack_trace"] is None for s in r["all_signals"])


@pytest.mark.parametrize("mode", ["checkpoint", "none"])
def test_materialize_modes_agree(spark, mode):
    df = spark.createDataFrame([(g[0], g[1]) for g in GOLDEN], ["job_id", "text"])
    lines = lines_from_text(df)
    base = sorted(map(str, analyze(lines, as_of="t").collect()))
    other = sorted(map(str, analyze(lines, as_of="t", materialize=mode).collect()))
    assert base == other


def test_empty_log_is_kept_when_jobs_are_given(spark):
    df = spark.createDataFrame([("empty", ""), ("blank", "\n  \n"), ("oom", OOM_TEXT)], ["job_id", "text"])
    rows = {r.job_id: r for r in analyze(lines_from_text(df), as_of="t", jobs=df).collect()}
    assert set(rows) == {"empty", "blank", "oom"}
    for j in ("empty", "blank"):
        c = rows[j]["job_context"]
        assert c["total_log_lines"] == 0 and c["platform"] == "unknown" and list(c["failed_stages"]) == []
        assert rows[j]["primary_signal"] is None and rows[j]["log_tail"] == "" and rows[j]["all_signals"] == []
    assert rows["oom"]["primary_signal"]["label"] == "OOM/Memory"


def test_undecodable_bytes_are_replaced(spark):
    import os
    import tempfile
    d = tempfile.mkdtemp(prefix="bytes-")
    raw = b"ok line\nbad \xff\xfe bytes ERROR OutOfMemoryError\n\xe2\x82 cut\n"
    with open(os.path.join(d, "x.log"), "wb") as f:
        f.write(raw)
    got = [r.value for r in read_logs(spark, d).orderBy("line_no").collect()]
    assert got == raw.decode("utf-8", errors="replace").splitlines()
    a = analyze(read_logs(spark, d), as_of="t").collect()[0]
    assert [s.label for s in a.all_signals] == ["OOM/Memory"]
