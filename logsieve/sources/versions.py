"""Versions of log files as a stream: every file that is new or has changed, once for each time that it is seen changed.

A Python data source for ``spark.readStream.format("log_versions")``. A row is (path, mtime, size, attempt). Options:
``path`` (folder), ``glob`` (of names), ``state`` (a folder of its own, shared like a checkpoint) and ``again`` (optional: a folder of Parquet
rows (path, attempt, again), as the watch's ledger writes them; files named there are given once more, with that attempt) and ``once``
("true": a file is given when it is new, and not when it changes).

An offset is the number of the last version batch. A batch is a file ``v=N.json`` in the state folder, written whole before its
offset is given to Spark; so a restart finds the same batches, and gives the ones that no one committed again. The state says what was
seen last of each file. It is written anew from time to time, with the batches before it removed, and forgets files that are gone ``FORGET``
seconds before the newest.
"""

from __future__ import annotations

import fnmatch
import json
import re
import sys
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from . import ranges as BR

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "path string, mtime timestamp, size bigint, attempt int"
#: Files of one task, batches between two full states, and seconds after which a file that is gone is forgotten.
TASK_FILES = 10_000
FULL_STATE = 50
FORGET = 7 * 86_400


class VersionPart(InputPartition):
    def __init__(self, rows: list) -> None:
        self.rows = rows


class VersionReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.options = dict(options)
        self.glob = self.options.get("glob", "*.log")
        self.fs, self.state = BR.file_system(self.options["state"])
        self.seen: dict[str, list] = {}  # path: [mtime in ns, size]
        self.ledgers: set[str] = set()
        self.version = self.full = 0
        self._load()

    # -- state ----------------------------------------------------------------
    def _files(self, folder: str, system=None) -> list:
        from pyarrow import fs

        return (system or self.fs).get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))

    def _read(self, name: str) -> dict:
        with self.fs.open_input_stream(f"{self.state}/{name}", compression=None) as f:
            return json.loads(f.read())

    def _write(self, name: str, what: dict) -> None:
        """The file appears whole or not at all."""
        self.fs.create_dir(self.state, recursive=True)
        with self.fs.open_output_stream(f"{self.state}/.{name}", compression=None) as f:
            f.write(json.dumps(what).encode())
        self.fs.move(f"{self.state}/.{name}", f"{self.state}/{name}")

    def _numbers(self, kind: str) -> list[int]:
        names = (f.base_name for f in self._files(self.state))
        return sorted(int(m[1]) for m in map(re.compile(rf"{kind}=(\d+)\.json$").match, names) if m)

    def _load(self) -> None:
        fulls = self._numbers("full")
        if fulls:
            self.version = self.full = fulls[-1]
            was = self._read(f"full={self.full}.json")
            self.seen, self.ledgers = was["seen"], set(was["ledgers"])
        for n in self._numbers("v"):
            if n > self.version:
                self._apply(self._read(f"v={n}.json"))
                self.version = n

    def _apply(self, batch: dict) -> None:
        self.seen.update({path: [mtime, size] for path, mtime, size, _ in batch["files"]})
        self.ledgers.update(batch["ledgers"])

    # -- what changed -----------------------------------------------------------
    def _listed(self) -> dict[str, list]:
        """Files by their plain name; hidden ones (``.`` or ``_`` before a name) don't count."""
        system, base = BR.file_system(self.options["path"])
        base, given, out = base.rstrip("/"), re.sub("^file:/+", "/", self.options["path"]).rstrip("/"), {}
        for f in self._files(base, system):
            inside = f.path[len(base) + 1:]
            if f.is_file and fnmatch.fnmatchcase(f.base_name, self.glob) and not any(x[0] in "._" for x in inside.split("/")):
                out[f"{given}/{inside}"] = [f.mtime_ns or 0, f.size or 0]
        return out

    def _again(self) -> tuple[dict[str, int], list[str]]:
        """(attempt by path, ledger files) that weren't taken up yet."""
        if not self.options.get("again"):
            return {}, []
        import pyarrow.parquet as pq

        system, base = BR.file_system(self.options["again"])
        paths, names = {}, []
        for f in self._files(base, system):
            if f.is_file and f.base_name.endswith(".parquet") and f.path not in self.ledgers:
                names.append(f.path)
                rows = pq.read_table(f.path, filesystem=system, columns=["path", "attempt", "again"]).to_pylist()
                paths.update({r["path"]: r["attempt"] for r in rows if r["again"]})
        return paths, names

    # -- the stream ---------------------------------------------------------------
    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        listed = self._listed()
        again, ledgers = self._again()
        once = self.options.get("once") == "true"
        files = [[p, *v, again.get(p, 0)] for p, v in sorted(listed.items())
                 if p in again or (p not in self.seen if once else self.seen.get(p, [-1])[0] < v[0])]
        if files or ledgers:
            batch = {"files": files, "ledgers": ledgers}
            self._write(f"v={self.version + 1}.json", batch)
            self.version += 1
            self._apply(batch)
            newest = max((v[0] for v in self.seen.values()), default=0)
            self.seen = {p: v for p, v in self.seen.items() if p in listed or v[0] > newest - FORGET * 10**9}
        return {"version": self.version}

    def partitions(self, start: dict, end: dict) -> list[VersionPart]:
        rows: dict[str, list] = {}
        for n in range(start["version"] + 1, end["version"] + 1):
            rows.update({r[0]: r for r in self._read(f"v={n}.json")["files"]})  # the last version of a file
        rows = list(rows.values())
        return [VersionPart(rows[i:i + TASK_FILES]) for i in range(0, len(rows), TASK_FILES)]

    def read(self, partition: VersionPart) -> Iterator[tuple]:
        for path, mtime, size, attempt in partition.rows:
            yield path, datetime.fromtimestamp(mtime / 1e9, timezone.utc), size, attempt

    def commit(self, end: dict) -> None:
        """Batches up to a committed one are needed no more once a full state holds what they said."""
        done = end["version"]
        if done - self.full >= FULL_STATE and done == self.version:
            self._write(f"full={done}.json", {"seen": self.seen, "ledgers": sorted(self.ledgers)})
            for n in self._numbers("v"):
                if n <= done:
                    self.fs.delete_file(f"{self.state}/v={n}.json")
            for n in self._numbers("full"):
                if n < done:
                    self.fs.delete_file(f"{self.state}/full={n}.json")
            self.full = done


class LogVersions(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_versions"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> VersionReader:
        return VersionReader(self.options)


def stream_versions(spark: SparkSession, path: str, state: str, glob: str = "*.log", again: str | None = None, once: bool = False):
    """New and changed files below ``path`` as a stream of (path, mtime, size, attempt); with ``once`` only new ones."""
    spark.dataSource.register(LogVersions)
    r = spark.readStream.format("log_versions").option("path", path).option("glob", glob).option("state", state).option("once", str(once).lower())
    return (r.option("again", again) if again else r).load()
