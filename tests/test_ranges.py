"""Files by byte range: any cut gives Python's lines and numbers; a tail costs its own bytes; no line is shuffled."""

import gzip
import os
import re
import tempfile
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logsieve.sources import files as FS
from logsieve.sources import ranges as BR

PIECES = st.lists(st.sampled_from(["", "a", "  ", "é€", "x" * 40, "\x0b", "\u2028", "\x1c ", "\ufeff", "ERROR b"]), max_size=6).map("".join)
TEXTS = st.lists(st.tuples(PIECES, st.sampled_from(["\n", "\n", "\r\n", "\r", ""])), max_size=30).map(lambda x: "".join(a + b for a, b in x))


def put(folder, name, data):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)
    return path


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 60), st.sampled_from([1, 3, 7, 1 << 16]))
def test_ranges_hold_each_line_once(text, size, block):
    data = text.encode() + b"\xff\xc3"  # not UTF-8, no line end
    path, was = put(tempfile.mkdtemp(prefix="ranges-"), "a.log", data), BR.BLOCK
    BR.BLOCK = block
    try:
        got = [x for lo in range(0, len(data), size) for part in BR.lines_of(path, lo, min(len(data), lo + size)) for x in part]
    finally:
        BR.BLOCK = was
    assert got == data.decode("utf-8", errors="replace").splitlines()


def plain_lines(data):
    idx, out = 0, []
    for i, x in enumerate(data.decode("utf-8", errors="replace").splitlines(), 1):
        idx += bool(x.strip())
        out.append((i, idx if x.strip() else None, x))
    return out


LOGS = {"a.log": b"one\r\n\r\n two\rthree\n\n" * 40 + b"end", "b c/[d].log": b"", "e.log": b"\n\n \n", "f.log": b"x" * 5000 + b"\n" + b"y\n" * 700,
        "g.log": "é\u2028ü\n".encode() * 300 + b"\xff"}


@pytest.mark.parametrize("size", [1, 64, 1000, 1 << 20])
def test_numbers_do_not_depend_on_the_ranges(spark, size):
    base = tempfile.mkdtemp(prefix="logs-")
    for name, data in LOGS.items():
        put(base, name, data if size > 1 else data[:90])
    with gzip.open(os.path.join(base, "z.log.gz"), "wb") as f:
        f.write(LOGS["a.log"])
    rows = FS.read_logs(spark, base, "*.log*", range_bytes=size, task_bytes=4 * size).collect()
    got = {}
    for r in rows:
        assert r.job_id == r.path
        got.setdefault(os.path.relpath(r.path, base), []).append((r.line_no, r.idx, r.value))
    want = {n: plain_lines(d if size > 1 else d[:90]) for n, d in LOGS.items()} | {"z.log.gz": plain_lines(LOGS["a.log"])}
    assert {n: sorted(x) for n, x in got.items()} == {n: x for n, x in want.items() if x}
    assert {r.job_name for r in rows} == {"a", "e", "f", "g", "z.log"}


def test_job_of_several_files_and_only(spark):
    base = tempfile.mkdtemp(prefix="logs-")
    put(base, "job=x/1.log", b"one\n\ntwo\n")
    put(base, "job=x/2.log", b"three\nfour")
    put(base, "job=y/1.log", b"other\n")
    lines = FS.read_logs(spark, base, job="dir", range_bytes=4, only=spark.createDataFrame([("x",)], "job_id string"))
    assert sorted((r.job_id, r.line_no, r.idx, r.value) for r in lines.collect()) == [
        ("x", 1, 1, "one"), ("x", 2, None, ""), ("x", 3, 2, "two"), ("x", 4, 3, "three"), ("x", 5, 4, "four")]


def test_spark_reader_agrees(spark, data_dir):
    cols = ["job_id", "job_name", "path", "line_no", "idx", "value"]
    mine, theirs = (sorted(map(tuple, FS.read_logs(spark, data_dir, reader=r).select(*cols).collect()), key=str) for r in ("ranges", "spark"))
    assert mine == theirs and mine
    assert BR.can_open("/a") and BR.can_open("file:/a") and BR.can_open("s3a://b/c") and not BR.can_open("viewfs://x/y")


def test_no_line_is_shuffled(spark, data_dir):
    lines = FS.read_logs(spark, data_dir, range_bytes=100)
    plan = spark._jvm.PythonSQLUtils.explainString(lines._jdf.queryExecution(), "formatted")
    exchanges = re.findall(r"\n\(\d+\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", plan)
    assert exchanges and not any("value" in e for e in exchanges)
    after = plan[:plan.index("MapInArrow")]  # from the result down to the pass that reads the lines
    assert "Window" not in after and "Exchange" not in after and "Sort" not in after


def test_errors_as_rows(spark):
    base = tempfile.mkdtemp(prefix="logs-")
    good, bad = put(base, "good.log", b"a\nb\n"), put(base, "bad.log.gz", b"this is no gzip stream at all")
    listing = spark.createDataFrame([(good, 4), (bad, 29), (os.path.join(base, "gone.log"), 10)], "path string, size long")
    rows = FS.read_files(listing, errors=True).collect()
    assert sorted(r.value for r in rows if r.error is None) == ["a", "b"]
    assert {os.path.basename(r.path) for r in rows if r.error} == {"bad.log.gz", "gone.log"}
    with pytest.raises(Exception, match="gone.log"):
        FS.read_files(listing.where("path LIKE '%gone%'")).collect()


def test_tail_costs_its_own_bytes(spark):
    base = tempfile.mkdtemp(prefix="logs-")
    end = "é ERROR the end\r\nof it".encode()
    huge = put(base, "huge.log", b"")
    with open(huge, "r+b") as f:
        f.truncate(50 << 30)  # a sparse file: reading it whole would take minutes
        f.seek(0, 2)
        f.write(end)
    small = put(base, "small.log", b"a\r\n\xc3")
    paths = [(huge,), (small,), (os.path.join(base, "gone.log"),)]
    began = time.time()
    got = {os.path.basename(r.path): r.text for r in FS.tail_files(spark.createDataFrame(paths, "path string"), len(end) - 1).collect()}
    assert time.time() - began < 30
    assert got == {"huge.log": "\ufffd ERROR the end\r\nof it", "small.log": "a\r\n\ufffd", "gone.log": ""}


def test_empty_folder(spark):
    assert FS.read_logs(spark, tempfile.mkdtemp(prefix="logs-")).collect() == []
