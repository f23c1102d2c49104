"""Folders of many files are listed and written by tasks: the driver holds no list and moves no folder, and names are Spark's."""

import os
import tempfile

import pytest
from pyspark.sql import DataFrameWriter

from logsieve.sources import files as FS

NAMES = ["a.log", "ab.log", "b1.log", "b c/[d].log", "+%41/é.log", "_h/a.log", "_k=1/a.log", ".x/a.log", "d/_a.log", "d/.b.log", "d/c.txt",
         "d/e.log._COPYING_", "d/f.log", "d/[x].log", "d/a,b.log", "g/h/i/j.log"]


@pytest.fixture(scope="module")
def folder():
    base = tempfile.mkdtemp(prefix="listing-")
    for name in [*NAMES, "empty.log"]:
        path = os.path.join(base, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write("" if name == "empty.log" else name)
    os.symlink(os.path.join(base, "g"), os.path.join(base, "link"))
    return base


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("glob", ["*.log", "*", "[ab]*.log", "[a-b].log", "{a,b1}.log", "?.log", "[^a]*.log", "[!a]*.log", "\\[x\\].log", "*.{log,txt}", "a,b.log"])
def test_listing_is_sparks(spark, folder, glob):
    got = FS.file_listing(spark, folder, glob)
    assert rows(got) == rows(FS._listing_by_spark(spark, folder, glob)) and got.columns == ["path", "mtime", "size"]


def test_listing_holds_no_files_in_the_driver(spark, folder):
    plan = FS.file_listing(spark, folder)._jdf.queryExecution().toString()
    assert "binaryFile" not in plan


def test_roots_of_every_kind(spark, folder):
    for root in ([folder + "/d", folder], folder + "/a.log", folder + "/d/c.txt", "file://" + folder, folder + "/"):
        assert rows(FS.file_listing(spark, root)) == rows(FS._listing_by_spark(spark, root, "*.log"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        FS.file_listing(spark, folder + "/gone").collect()


def test_older_files_are_left_out(spark):
    base = tempfile.mkdtemp(prefix="listing-")
    for name, at in (("old.log", 1_700_000_000), ("new.log", 1_700_000_002)):
        with open(os.path.join(base, name), "w") as f:
            f.write("x")
        os.utime(os.path.join(base, name), (at, at))
    for after, n in (("2023-11-14T22:13:20", 1), ("2023-11-14T22:13:19", 2), ("2023-11-14T22:13:22", 0)):
        got = rows(FS.file_listing(spark, base, "*.log", after))
        assert len(got) == n and got == rows(FS._listing_by_spark(spark, base, "*.log", after))


def texts(base):
    out = {}
    for at, _, names in os.walk(base):
        for name in sorted(names):
            if name.endswith(".txt"):
                with open(os.path.join(at, name), "rb") as f:
                    out[os.path.relpath(at, base)] = out.get(os.path.relpath(at, base), b"") + f.read()
            else:
                assert name in ("_SUCCESS", "._SUCCESS.crc") or name.endswith(".crc"), name
    return out


def test_written_folders_are_sparks(spark, monkeypatch):
    base = tempfile.mkdtemp(prefix="written-")
    some = [("a[1]:/x", 1, "p"), ("a[1]:/x", 2, None), (None, 1, "q"), ("", 1, "r"), ("é \x01{}", 1, "s"), ("b", 1, "t "), ("w^%=?#\"'*\\~&|", 1, "")]
    lines = spark.createDataFrame(some + [(f"job_{i % 50}", i, f"line {i}") for i in range(2000)], "job_id string, line_no long, value string")
    ordered = lines.repartitionByRange("job_id", "line_no").sortWithinPartitions("job_id", "line_no").select("job_id", "value")
    ordered.write.partitionBy("job_id").text(base + "/theirs")
    monkeypatch.setattr(DataFrameWriter, "text", lambda *a, **k: pytest.fail("Spark's committer moves each folder from the driver"))
    for _ in range(2):  # overwritten
        FS.write_log_files(lines, base + "/mine")
    assert texts(base + "/mine") == texts(base + "/theirs")
    with pytest.raises(ValueError, match="exists"):
        FS.write_log_files(lines, base + "/mine", "error")
    FS.write_log_files(lines, base + "/mine", "append")
    assert len(texts(base + "/mine")["job_id=b"]) == 2 * len(texts(base + "/theirs")["job_id=b"])
