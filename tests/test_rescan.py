"""Changed logs are found by listing against a versioned manifest; a failed run loses nothing."""

import os
import tempfile
import time

import pytest

from logsieve.streaming import rescan as RS

FAIL = "24/01/01 00:00:00 ERROR Executor: java.lang.OutOfMemoryError: Java heap space in task\n"


def folders():
    base = tempfile.mkdtemp(prefix="rescan-")
    logs = os.path.join(base, "logs")
    os.makedirs(logs)
    return logs, os.path.join(base, "manifest"), os.path.join(base, "out")


def put(logs, name, text, mode="w"):
    path = os.path.join(logs, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as f:
        f.write(text)
    os.utime(path)


def test_rescan_reads_new_then_only_changed(spark):
    logs, manifest, _ = folders()
    put(logs, "a[1].log", "x ERROR one\n")
    put(logs, "d/b c.log", "y WARN two\n")
    scan = RS.rescan(spark, logs, manifest)
    assert {(r.job_name, r.value) for r in scan.lines.collect()} == {("a[1]", "x ERROR one"), ("b c", "y WARN two")}
    assert scan.commit() == 0
    scan = RS.rescan(spark, logs, manifest)
    assert scan.lines.count() == 0 and scan.commit() == 1
    time.sleep(1.1)
    put(logs, "d/b c.log", "z ERROR OutOfMemoryError\n", "a")
    scan = RS.rescan(spark, logs, manifest)
    got = sorted((r.job_name, r.line_no, r.value) for r in scan.lines.collect())
    assert scan.commit() == 2 and got == [("b c", 1, "y WARN two"), ("b c", 2, "z ERROR OutOfMemoryError")]


def test_uncommitted_scan_is_made_again(spark):
    logs, manifest, _ = folders()
    put(logs, "a.log", "x ERROR one\n")
    for _ in range(2):
        scan = RS.rescan(spark, logs, manifest)
        assert scan.version == 0 and scan.lines.count() == 1


def test_failed_run_keeps_the_change_for_the_next(spark, monkeypatch):
    logs, manifest, out = folders()
    put(logs, "a.log", FAIL)
    whole = RS.triage_batch
    monkeypatch.setattr(RS, "triage_batch", lambda *a, **k: (_ for _ in ()).throw(OSError("read failed")))
    with pytest.raises(OSError):
        RS.rescan_to_outbox(spark, logs, manifest, out, as_of="T")
    monkeypatch.setattr(RS, "triage_batch", whole)
    assert RS.rescan_to_outbox(spark, logs, manifest, out, as_of="T") == 0
    rows = spark.read.parquet(f"{out}/scan=0").collect()
    assert {(r.subject.split(" | ")[0], r.severity) for r in rows} == {("[CRITICAL] Spark Job Failed: a", "CRITICAL")}
    assert RS.rescan_to_outbox(spark, logs, manifest, out, as_of="T") == 1
    assert spark.read.parquet(f"{out}/scan=1").count() == 0


def test_job_of_several_files_is_read_whole(spark):
    logs, manifest, _ = folders()
    put(logs, "job=x/1.log", "one\n")
    put(logs, "job=y/1.log", "other\n")
    RS.rescan(spark, logs, manifest, job="dir").commit()
    time.sleep(1.1)
    put(logs, "job=x/2.log", "two\n")
    scan = RS.rescan(spark, logs, manifest, job="dir")
    assert sorted((r.job_id, r.line_no, r.value) for r in scan.lines.collect()) == [("x", 1, "one"), ("x", 2, "two")]
