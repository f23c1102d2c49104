"""New files as a stream of lines, found by listing their versions: none is lost, read twice or taken up again when it changes."""

import os
import tempfile
import time

import pyarrow as pa
from pyspark.sql import functions as F

from logsieve.sources import files as FS
from logsieve.sources import ranges as BR
from logsieve.streaming import watch as W

FAIL = "24/01/01 00:00:00 ERROR Executor: java.lang.OutOfMemoryError: Java heap space in task\n"


def put(folder, name, text, mode="w"):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as f:
        f.write(text)


def test_new_files_with_a_state(spark):
    src, out = tempfile.mkdtemp(prefix="lines-src-"), tempfile.mkdtemp(prefix="lines-out-")

    def step():
        lines = W.stream_logs(spark, src, state=f"{out}/_checkpoint/files").select(F.element_at(F.split("path", "/"), -2).alias("job_id"), "value")
        W.write_signal_counts(lines, out, available_now=True).awaitTermination()
        return {r.job_id: r.n for r in W.latest_signal_counts(spark, out).collect()}

    put(src, "a b/50%.log", FAIL * 3 + "plain\n\n")
    put(src, "c/empty.log", "")
    assert step() == {"a b": 3}
    time.sleep(0.02)
    put(src, "a b/50%.log", FAIL, "a")  # a file that changes is not read again
    put(src, "a b/2.log", FAIL[:-1])
    put(src, "d/1.log", FAIL * 20_000)
    want = {"a b": 4, "d": 20_000}
    assert step() == want and step() == want


def test_no_task_for_each_folder(spark):
    """Spark's file source lists every folder in a task of its own: its jobs grow with the folders."""
    src, out = tempfile.mkdtemp(prefix="lines-src-"), tempfile.mkdtemp(prefix="lines-out-")
    for i in range(60):
        put(src, f"{i}/1.log", FAIL)
    lines = W.stream_logs(spark, src, state=f"{out}/files")
    assert not any(s in lines._jdf.queryExecution().analyzed().toString() for s in ("FileSource", "FileStreamSource"))
    lines = lines.select("path", "blk", "value")
    q = lines.writeStream.foreachBatch(lambda b, n: b.write.parquet(f"{out}/batch={n}")).option(
        "checkpointLocation", f"{out}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(f"{out}/batch=0").collect()
    assert sorted(r.path for r in rows) == sorted(f"{src}/{i}/1.log" for i in range(60)) and {(r.blk, r.value) for r in rows} == {(0, FAIL[:-1])}


def test_small_ranges_read_little_beyond(monkeypatch):
    """A range reads its own bytes and a little for the end of its last line, not a block of a large file; long lines come whole."""
    src, read = tempfile.mkdtemp(prefix="lines-src-"), []
    text = "".join(f"line {i}\n" for i in range(300_000)) + "x" * 300_000 + "\nend\n"
    put(src, "big.log", text)
    whole = BR._whole_lines
    monkeypatch.setattr(BR, "_whole_lines", lambda f, size: whole(lambda n: (read.append(n), f(n))[1], size))
    lines = [x for s in range(0, len(text), 50_000) for part in BR.lines_of(f"{src}/big.log", s, min(s + 50_000, len(text))) for x in part]
    assert lines == text.splitlines()
    assert sum(read) < 2 * len(text)


def test_no_swarm_of_small_tasks():
    """Small tasks are bounded by the cores, so that 6 GB in ranges of 1000 bytes isn't 120,000 tasks; large ones grow with the bytes."""
    assert FS._tasks(10**6, 1000, 50_000, 8) == 20
    assert FS._tasks(6 * 10**9, 6 * 10**6, 50_000, 12) == FS.SMALL_TASKS * 12
    assert FS._tasks(10**13, 10**6, FS.TASK_BYTES, 12) == -(-10**13 // FS.TASK_BYTES)
    assert FS._tasks(100, 3, 50_000, 8) == 3 and FS._tasks(0, 0, 50_000, 8) == 1


def test_small_ranges_share_batches():
    """Ranges of a few lines come back in few batches, in their order, with the rows that say what can't be read."""
    src = tempfile.mkdtemp(prefix="lines-src-")
    rows = []
    for i in range(300):
        put(src, f"{i}.log", f"x{i}\n\ny{i}\n")
        rows.append({"job_id": str(i), "job_name": "n", "path": f"{src}/{i}.log", "start": 0, "end": 7, "lines": 0, "texts": 0, "n_text": None, "n_chars": None})
    rows.append({**rows[0], "job_id": "gone", "path": f"{src}/gone.log"})
    ranges = pa.RecordBatch.from_pylist(rows, schema=pa.schema(
        [(c, pa.string() if c in ("job_id", "job_name", "path") else pa.int64()) for c in rows[0]]))
    got = list(BR.number_lines_of(True)(iter([ranges])))
    assert len(got) == 1 and got[0].num_rows == 901
    lines = got[0].to_pylist()
    assert [(r["job_id"], r["line_no"], r["idx"], r["value"]) for r in lines[3:6]] == [("1", 1, 1, "x1"), ("1", 2, None, ""), ("1", 3, 2, "y1")]
    assert lines[3]["n_text"] == 2 and lines[3]["n_chars"] == 6 and lines[3]["error"] is None
    assert lines[-1]["job_id"] == "gone" and lines[-1]["value"] is None and "FileNotFound" in lines[-1]["error"]
    counts = list(BR.count_lines(True)(iter([ranges])))
    assert len(counts) == 1 and counts[0].num_rows == 301 and counts[0].to_pylist()[7]["n"] == 3 and counts[0].to_pylist()[300]["n"] == 0
