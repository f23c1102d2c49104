"""Stream equals batch: the watch over a folder gives the batch report; nothing is lost or merged."""

import os
import shutil
import tempfile
import time
from collections import Counter

from pyspark.sql import functions as F

from logsieve import triage_report
from logsieve.sources.files import read_logs
from logsieve.streaming import watch as W
from logsieve.streaming.watch import read_errors, read_outbox, watch_logs

FAIL = "24/01/01 00:00:00 ERROR Executor: java.lang.OutOfMemoryError: Java heap space in task\n"


def run(spark, src, out, **how):
    watch_logs(spark, src, out, available_now=True, as_of="T", **how).awaitTermination()
    return read_outbox(spark, out)


def put(folder, name, text):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb" if isinstance(text, bytes) else "w") as f:
        f.write(text)
    return path


def test_watch_equals_batch(spark, data_dir):
    out = tempfile.mkdtemp(prefix="watch-out-")
    streamed = Counter(tuple(r) for r in run(spark, data_dir, out).collect())
    batch = Counter(tuple(r) for r in triage_report(read_logs(spark, data_dir), as_of="T")
                    .select("job_id", "recipient", "severity", "subject", "body").collect())
    assert streamed == batch and len(batch) == 6      # 3 logs x 2 recipients, all CRITICAL/HIGH


def test_same_names_blanks_and_brackets(spark):
    src, out = tempfile.mkdtemp(prefix="watch src-"), tempfile.mkdtemp(prefix="watch-out-")
    names = ["dag_a/t/d/1.log", "dag_b/t/d/1.log", "x y/my job.log", "a[1]/a[1].log", "p+q/50%.log", "é/é.log"]
    for n in names:
        put(src, n, FAIL)
    rows = run(spark, src, out, recipients="me").collect()
    assert sorted(r.job_id for r in rows) == sorted(os.path.join(src, n) for n in names)
    assert sorted(r.subject.split(" | ")[0].split(": ")[1] for r in rows) == sorted(["1", "1", "my job", "a[1]", "50%", "é"])


def test_restart_without_a_checkpoint_argument(spark, data_dir):
    src, out = tempfile.mkdtemp(prefix="watch-src-"), tempfile.mkdtemp(prefix="watch-out-")
    shutil.copy(os.path.join(data_dir, "oom_sample.log"), src)
    assert {os.path.basename(r.job_id) for r in run(spark, src, out).collect()} == {"oom_sample.log"}
    shutil.copy(os.path.join(data_dir, "kafka_timeout.log"), src)
    os.remove(os.path.join(src, "oom_sample.log"))  # rotated out: its alert stays
    rows = run(spark, src, out).collect()
    assert Counter(os.path.basename(r.job_id) for r in rows) == {"oom_sample.log": 2, "kafka_timeout.log": 2}


def test_another_checkpoint_does_not_overwrite(spark):
    src, out = tempfile.mkdtemp(prefix="watch-src-"), tempfile.mkdtemp(prefix="watch-out-")
    put(src, "first.log", FAIL)
    run(spark, src, out, checkpoint=tempfile.mkdtemp(prefix="ckpt-"))
    os.remove(os.path.join(src, "first.log"))
    put(src, "second.log", FAIL)
    rows = run(spark, src, out, checkpoint=tempfile.mkdtemp(prefix="ckpt-"))
    assert {os.path.basename(r.job_id) for r in rows.collect()} == {"first.log", "second.log"}


def test_watch_skips_tiny_logs(spark, data_dir):
    src, out = tempfile.mkdtemp(prefix="watch-src-"), tempfile.mkdtemp(prefix="watch-out-")
    shutil.copy(os.path.join(data_dir, "kafka_timeout.log"), src)
    put(src, "tiny.log", "\n  ERROR OutOfMemoryError  \n\n")        # 24 characters once stripped
    assert {os.path.basename(r.job_id) for r in run(spark, src, out).collect()} == {"kafka_timeout.log"}


def test_a_bad_log_becomes_a_row(spark):
    src, out = tempfile.mkdtemp(prefix="watch-src-"), tempfile.mkdtemp(prefix="watch-out-")
    put(src, "good.log", FAIL)
    put(src, "bad.log.gz", b"this is no gzip stream at all")
    rows = run(spark, src, out, glob="*.log*").collect()
    assert {os.path.basename(r.job_id) for r in rows} == {"good.log"}
    errors = spark.read.option("recursiveFileLookup", "true").parquet(f"{out}/_errors").collect()
    assert [os.path.basename(r.path) for r in errors] == ["bad.log.gz"] and errors[0].error


def subjects(rows):
    return Counter(os.path.basename(r.job_id) for r in rows if r.recipient == "me")


def test_a_log_that_grows_is_triaged_again(spark):
    src, out = tempfile.mkdtemp(prefix="watch-src-"), tempfile.mkdtemp(prefix="watch-out-")
    put(src, "a.log", "INFO nothing to see here yet, the job is only running\n" * 2)
    put(src, "b.log", FAIL)
    found = lambda: Counter((os.path.basename(r.job_id), r.severity) for r in run(spark, src, out, recipients="me").collect())
    assert found() == {("a.log", "HIGH"): 1, ("b.log", "CRITICAL"): 1}  # HIGH: no rule matches
    time.sleep(0.02)
    with open(os.path.join(src, "a.log"), "a") as f:
        f.write(FAIL)
    after = {("a.log", "HIGH"): 1, ("a.log", "CRITICAL"): 1, ("b.log", "CRITICAL"): 1}
    assert found() == after
    assert found() == after  # nothing changed: nothing again


def test_running_watch_sees_the_change(spark):
    src, out = tempfile.mkdtemp(prefix="watch-src-"), tempfile.mkdtemp(prefix="watch-out-")
    put(src, "a.log", FAIL)
    q = watch_logs(spark, src, out, interval="1 seconds", as_of="T", recipients="me")
    try:
        for want in (1, 2):
            for _ in range(120):
                if want == sum(1 for d, _, names in os.walk(out) if "_SUCCESS" in names and "batch_id=" in d and "_errors" not in d):
                    break
                time.sleep(0.5)
            q.processAllAvailable()
            assert subjects(read_outbox(spark, out).collect()) == {"a.log": want}
            put(src, "a.log", FAIL * (want + 1))
    finally:
        q.stop()


def test_an_outage_leaves_no_log_unreported(spark, monkeypatch):
    src, out = tempfile.mkdtemp(prefix="watch-src-"), tempfile.mkdtemp(prefix="watch-out-")
    for n in ("a.log", "b.log", "c.log"):
        put(src, n, FAIL)
    whole = W.triage_batch
    monkeypatch.setattr(W, "PAUSE", 0)
    monkeypatch.setattr(W, "triage_batch", lambda *a, **k: (_ for _ in ()).throw(OSError("the sink is away")))
    watch_logs(spark, src, out, available_now=True, as_of="T", recipients="me").awaitTermination()
    rows = read_errors(spark, out).collect()
    assert {(os.path.basename(r.path), r.attempt, r.again) for r in rows} == {(n, 1, True) for n in ("a.log", "b.log", "c.log")}
    assert all("the sink is away" in r.error for r in rows)
    monkeypatch.setattr(W, "triage_batch", whole)
    assert subjects(run(spark, src, out, recipients="me").collect()) == {"a.log": 1, "b.log": 1, "c.log": 1}


def test_one_log_that_cannot_be_triaged(spark, monkeypatch):
    src, out = tempfile.mkdtemp(prefix="watch-src-"), tempfile.mkdtemp(prefix="watch-out-")
    for i in range(9):
        put(src, f"good{i}.log", FAIL)
    put(src, "bad.log", FAIL + "POISON\n")
    whole = W.triage_batch

    def poisoned(lines, *a, **k):
        if lines.where("value = 'POISON'").count():
            raise RuntimeError("this log can't be triaged")
        return whole(lines, *a, **k)

    monkeypatch.setattr(W, "PAUSE", 0)
    monkeypatch.setattr(W, "triage_batch", poisoned)
    good = {f"good{i}.log": 1 for i in range(9)}
    for attempt in (1, 2, 3, 3):
        assert subjects(run(spark, src, out, recipients="me").collect()) == good
        [r] = read_errors(spark, out).collect()
        assert (os.path.basename(r.path), r.attempt, r.again) == ("bad.log", attempt, attempt < 3)


def test_versions_survive_a_restart(spark):
    """Batches that were seen but not committed come again; committed ones don't, also after the state was written anew."""
    from logsieve.sources.versions import VersionReader
    src, state = tempfile.mkdtemp(prefix="watch-src-"), tempfile.mkdtemp(prefix="state-")
    names = lambda r, a, b: sorted(os.path.basename(x[0]) for p in r.partitions({"version": a}, {"version": b}) for x in r.read(p))
    put(src, "a.log", "1")
    r = VersionReader({"path": src, "state": state})
    assert r.initialOffset() == {"version": 0} and r.latestOffset() == {"version": 1} and r.latestOffset() == {"version": 1}
    put(src, "_tmp/b.log", "1")
    put(src, ".b.log", "1")
    put(src, "c.txt", "1")
    r = VersionReader({"path": src, "state": state})
    assert r.latestOffset() == {"version": 1} and names(r, 0, 1) == ["a.log"]
    for k in range(2, 60):
        time.sleep(0.002)
        put(src, "a.log" if k % 2 else "d.log", str(k))
        assert r.latestOffset() == {"version": k}
        assert names(r, k - 1, k) == ["a.log" if k % 2 else "d.log"]
        r.commit({"version": k})
    assert len(os.listdir(state)) < 20
    assert VersionReader({"path": src, "state": state}).latestOffset() == {"version": 59}


def test_signal_counts_add_up_are_compacted_and_expire(spark):
    src, out = tempfile.mkdtemp(prefix="counts-src-"), tempfile.mkdtemp(prefix="counts-out-")

    def step(**how):
        lines = W.stream_logs(spark, src).select(F.element_at(F.split("path", "/"), -1).alias("job_id"), "value")
        W.write_signal_counts(lines, out, available_now=True, compact_every=3, **how).awaitTermination()
        return {(r.job_id, r.label): (r.n, r.severity) for r in W.latest_signal_counts(spark, out).collect()}

    want, run = {}, None
    for k in range(8):
        put(src, f"{k}.log", FAIL * (k + 1) + "plain line\n")
        want[(f"{k}.log", "OOM/Memory")] = (k + 1, "CRITICAL")
        assert step() == want
        run = [os.path.join(out, d) for d in os.listdir(out) if d.startswith("run=")]
        assert len(run) == 1
    kept = sorted(d for d in os.listdir(run[0]))
    assert kept == ["batch_id=3", "batch_id=4", "batch_id=5", "batch_id=6", "batch_id=7", "version=2", "version=5"]
    time.sleep(1.2)
    put(src, "8.log", FAIL)
    assert step(expire="1 seconds") == {("8.log", "OOM/Memory"): (1, "CRITICAL")}  # the third batch since: a version without the jobs that ended
    lines = W.stream_logs(spark, src).select(F.lit("x").alias("job_id"), "value")
    W.write_signal_counts(lines, out, checkpoint=tempfile.mkdtemp(prefix="ckpt-"), available_now=True).awaitTermination()
    got = {r.job_id: r.n for r in W.latest_signal_counts(spark, out).collect()}
    assert got == {"8.log": 1, "x": 37}  # another run adds its own rows
