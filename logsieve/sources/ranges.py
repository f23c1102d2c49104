"""Log files read by byte range.

A range of a file holds the lines that start in it, so fixed ranges cut a file the same way whoever reads them,
on any cluster, and a range can be read without the ones before it. Offsets, sizes and line counts of ranges are
ordinary Spark rows; the functions here turn such rows into lines, counts or tails inside ``mapInArrow``. They
seek, so a tail costs its own bytes whatever the size of the file.

Text is what Python's text mode gives: UTF-8 with U+FFFD for bytes that aren't, lines as ``str.splitlines`` cuts them,
blank if ``str.strip`` leaves nothing. Files are opened by Arrow's file systems (local and mounted paths, ``hdfs``, ``s3``, ``s3a``, ``gs``,
``abfs``); compressed ones (by name) are one range, read as a stream.
"""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle

# The functions travel to the executors with the tasks that call them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes read at a time, bytes read on for the end of a line, and lines handed on at a time.
BLOCK = 4 << 20
BEYOND = 1 << 12
BATCH_LINES = 8192
BATCH_BYTES = 8 << 20
#: Names of compressed logs, and Arrow's names of their codecs.
PACKED = {".gz": "gzip", ".bz2": "bz2", ".zst": "zstd", ".lz4": "lz4"}
PACKED_PATTERN = r"(?i)\.(gz|bz2|zst|lz4)$"
#: What a file that is gone, unreadable or no stream of its codec raises.
FAULTS = (OSError, pa.ArrowException)
OWN_SCHEMES = ("hdfs", "s3", "s3a", "gs", "abfs", "abfss")


def can_open(path: str) -> bool:
    """Whether the functions here can open ``path``: a plain or ``file:`` path, or one of a file system that Arrow has."""
    scheme = re.match(r"([a-zA-Z][a-zA-Z0-9+.-]*):/", path)
    return not scheme or scheme[1] in ("file", *OWN_SCHEMES)


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system that holds ``path``, and the path's name there."""
    from pyarrow import fs

    url = re.match(r"([a-zA-Z][a-zA-Z0-9+.-]*)://([^/]*)/(.*)", path, re.DOTALL)
    if not url or url[1] == "file":
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", path)
    system, root = fs.FileSystem.from_uri(f"{'s3' if url[1] == 's3a' else url[1]}://{url[2]}/")
    return system, f"{root.rstrip('/')}/{url[3]}"


def exists(path: str) -> bool:
    """Whether a folder or file ``path`` is there."""
    from pyarrow import fs

    system, name = file_system(path)
    return system.get_file_info(name).type != fs.FileType.NotFound


LISTED = "path string, folder boolean, mtime timestamp, size bigint"


def glob_pattern(glob: str) -> re.Pattern:
    """The names that a Hadoop glob stands for: ``*``, ``?``, ``[abc]``, ``[^abc]``, ``{a,b}`` and ``\\`` before a plain character."""
    out, inside, i = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        elif c == "[" and (end := glob.find("]", i + 2 + (glob[i + 1:i + 2] in ("^", "!")))) > 0:
            kept = glob[i + 1:end]
            negated = kept[:1] in ("^", "!")
            out.append(f"[{'^' * negated}{re.sub(r'([\\[&~|^])', r'\\\1', kept[negated:])}]")
            i = end
        elif c in "*?":
            out.append(".*" if c == "*" else ".")
        elif c == "{":
            inside += 1
            out.append("(?:")
        elif c == "}" and inside:
            inside -= 1
            out.append(")")
        else:
            out.append("|" if c == "," and inside else re.escape(c))
        i += 1
    return re.compile("".join(out), re.DOTALL)


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return name[0] == "." or name[0] == "_" and "=" not in name or name.endswith("._COPYING_")


def _entries(path: str) -> Iterator[tuple[str, bool, float, int]]:
    """(path, whether a folder, mtime in ns, size) of what is in a folder, or of the file ``path`` itself; nothing if it is gone."""
    from pyarrow import fs

    system, name = file_system(path)
    try:
        if isinstance(system, fs.LocalFileSystem):
            if not os.path.isdir(name):
                at = os.stat(name)
                yield path, False, at.st_mtime_ns, at.st_size
                return
            with os.scandir(name) as found:
                for x in found:
                    try:
                        at = x.stat()
                    except FileNotFoundError:
                        continue
                    yield f"{path.rstrip('/')}/{x.name}", x.is_dir(), at.st_mtime_ns, at.st_size
            return
        own = system.get_file_info(name)
        for f in [own] if own.is_file else system.get_file_info(fs.FileSelector(name, allow_not_found=True)):
            yield path if own.is_file else f"{path.rstrip('/')}/{f.base_name}", f.type == fs.FileType.Directory, f.mtime_ns or 0, f.size or 0
    except FileNotFoundError:
        return


def list_folders(glob: str):
    """``LISTED`` of what is in folders (path), or of files themselves: folders, and files whose names match; neither hidden nor empty ones.
    Times are cut to milliseconds, as Spark's listings have them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, rows = glob_pattern(glob), []
        for b in batches:
            for path in b.column(0).to_pylist():
                for at, folder, mtime, size in _entries(path):
                    name = at[at.rfind("/") + 1:]
                    if (at == path or not _hidden(name)) and (folder or size > 0 and names.fullmatch(name)):
                        rows.append((at, folder, mtime // 10**6 * 1000, size))
                    if len(rows) == BATCH_LINES:
                        yield listed(rows)
                        rows = []
        yield listed(rows)

    def listed(rows: list) -> pa.RecordBatch:
        types = [pa.string(), pa.bool_(), pa.timestamp("us", "UTC"), pa.int64()]
        columns = list(zip(*rows)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["path", "folder", "mtime", "size"])

    return run


#: What Spark escapes in the names of partition folders.
_ESCAPED = re.compile(r"[\x01-\x1f\x7f\"#%'*/:=?\\{\[\]^]")


def folder_name(key: str, value: str | None) -> str:
    """``key=value`` as Spark's ``partitionBy`` names a folder."""
    return f"{key}=" + (_ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", value) if value else "__HIVE_DEFAULT_PARTITION__")


def write_folders(base: str, keys: list[str], write: str):
    """Lines (keys, value), those of a key together, as a text file for each key and task, in the folder ``key=value/...`` in ``base``. A file appears whole
    or not at all; a task that is run again writes the same names."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, (system, root) = TaskContext.get(), file_system(base)
        name = f"part-{task.partitionId():05d}-{write}.txt"
        now, out, hidden, final = None, None, "", ""
        try:
            for b in batches:
                ids = list(zip(*([x or None for x in b.column(k).to_pylist()] for k in keys)))  # null and '' share a folder
                values = b.column("value").to_pylist()
                lo = 0
                while lo < len(ids):
                    key, hi = ids[lo], lo + 1
                    while hi < len(ids) and ids[hi] == key:
                        hi += 1
                    if out is None or key != now:
                        if out is not None:
                            out.close()
                            system.move(hidden, final)
                        folder = "/".join([root.rstrip("/"), *(folder_name(k, v) for k, v in zip(keys, key))])
                        system.create_dir(folder, recursive=True)
                        hidden, final = f"{folder}/.{name}.{task.taskAttemptId()}", f"{folder}/{name}"
                        out, now = system.open_output_stream(hidden, compression=None), key
                    out.write("".join([f"{x or ''}\n" for x in values[lo:hi]]).encode())
                    lo = hi
            if out is not None:
                out.close()
                system.move(hidden, final)
                out = None
        finally:
            if out is not None:
                out.close()
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())], names=["n"])

    return run


def blocks(path: str, start: int, end: int) -> Iterator[bytes]:
    """The bytes of the lines that start in [start, end), in blocks of whole lines."""
    system, name = file_system(path)
    codec = PACKED.get(name[name.rfind("."):].lower())
    if codec:
        with system.open_input_stream(name, compression=codec) as f:
            yield from _whole_lines(f.read, None)
        return
    with system.open_input_file(name) as f:
        at = start
        if start:  # the first line that starts here follows the first line end from the byte before
            f.seek(start - 1)
            at = start - 1
            while True:
                data = f.read(BEYOND)
                if not data:
                    return
                cut = data.find(b"\n")
                if cut >= 0:
                    at += cut + 1
                    break
                at += len(data)
                if at >= end:
                    return
            f.seek(at)
        if at < end:
            yield from _whole_lines(f.read, end - at)


def _whole_lines(read: Callable[[int], bytes], size: int | None) -> Iterator[bytes]:
    """Blocks that end at line ends; with ``size``, up to the first line end from byte ``size`` - 1 on."""
    kept, seen = [], 0
    while data := read(BLOCK if size is None else min(BLOCK, max(size - seen, seen // 2) + BEYOND)):
        last = data.find(b"\n", max(0, size - 1 - seen)) if size is not None and seen + len(data) >= size else -1
        if last >= 0:
            yield b"".join([*kept, data[:last + 1]])
            return
        seen += len(data)
        cut = data.rfind(b"\n") + 1 or data.rfind(b"\r", 0, len(data) - 1) + 1  # \r: lines that end in it alone
        if cut:
            yield b"".join([*kept, data[:cut]])
            kept = []
        kept.append(data[cut:])
    if any(kept):
        yield b"".join(kept)


def lines_of(path: str, start: int, end: int) -> Iterator[list[str]]:
    """The lines of a range, a block at a time."""
    for block in blocks(path, start, end):
        yield block.decode("utf-8", errors="replace").splitlines()


class Extent:
    """Where a text's first and last character that isn't white space are, over its blocks; line ends count as one character."""

    def __init__(self) -> None:
        self.size, self.first, self.last = 0, None, None

    def add(self, lines: list[str]) -> None:
        for x in lines:
            kept = x.strip()
            if kept:
                lead = x.index(kept[0])
                if self.first is None:
                    self.first = self.size + lead
                self.last = self.size + lead + len(kept)
            self.size += len(x) + 1

    @property
    def stripped(self) -> int:
        return 0 if self.first is None else self.last - self.first


def tail_of(path: str, max_bytes: int) -> str:
    """The last ``max_bytes`` bytes of a file as text."""
    system, name = file_system(path)
    with system.open_input_file(name) as f:
        f.seek(max(0, f.size() - max_bytes))
        return f.read().decode("utf-8", errors="replace")


COUNTED = "path string, start bigint, n bigint, n_text bigint, size bigint, first bigint, last bigint"


def count_lines(errors: bool):
    """``COUNTED`` of ranges (path, start, end): their lines, those that aren't blank, their characters, and where among these
    the first and the last are that aren't white space. ``errors``: a range
    that can't be read counts nothing (reading it will say why); else it fails the task."""
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        paths, *numbers = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), *(pa.array(x, pa.int64()) for x in numbers)],
                                          names=["path", "start", "n", "n_text", "size", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for r in b.to_pylist():
                n, text, extent = 0, 0, Extent()
                try:
                    for lines in lines_of(r["path"], r["start"], r["end"]):
                        n += len(lines)
                        text += sum(1 for x in lines if x.strip())
                        extent.add(lines)
                except FAULTS:
                    if not errors:
                        raise
                rows.append((r["path"], r["start"], n, text, extent.size, extent.first, extent.last))
                if len(rows) == BATCH_LINES:
                    yield batch_of(rows)
                    rows = []
        if rows:
            yield batch_of(rows)

    return run


def number_lines_of(errors: bool):
    """Lines of ranges (job_id, job_name, path, start, end, lines, texts, n_text, n_chars), numbered on from ``lines`` and ``texts``. ``n_text``
    and ``n_chars`` are the job's non-blank lines and the length of its stripped text; null: the range is the whole job, and is held until it is counted.

    ``errors``: a range that can't be read gives one row more, without a line, whose ``error`` says why; else it fails the task.
    """
    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        """Parts (range, line numbers, idx, values, totals, error), of one range or of several small ones, as one batch."""
        rs, numbers, idx, values, totals, faults = zip(*held)
        of = pa.array([k for k, v in enumerate(values) for _ in v], pa.int32())
        flat = lambda parts, kind: pa.array([x for p in parts for x in p], kind)
        out = [*(pa.array([r[c] for r in rs], pa.string()).take(of) for c in ("job_id", "job_name", "path")),
               flat(numbers, pa.int64()), flat(idx, pa.int64()), flat(values, pa.string()),
               *(pa.array(x, pa.int64()).take(of) for x in zip(*totals))]
        names = ["job_id", "job_name", "path", "line_no", "idx", "value", "n_text", "n_chars"]
        if errors:
            out, names = [*out, pa.array(faults, pa.string()).take(of)], [*names, "error"]
        return pa.RecordBatch.from_arrays(out, names=names)

    def one(r: dict) -> Iterator[tuple]:
        at, text, totals = r["lines"], r["texts"], (r["n_text"], r["n_chars"])
        parts = lines_of(r["path"], r["start"], r["end"])
        if r["n_text"] is None:
            parts, extent = list(parts), Extent()
            for lines in parts:
                extent.add(lines)
            totals = sum(1 for lines in parts for x in lines if x.strip()), extent.stripped
        for lines in parts:
            for lo in range(0, len(lines), BATCH_LINES):
                part, idx = lines[lo:lo + BATCH_LINES], []
                for x in part:
                    if x.strip():
                        text += 1
                        idx.append(text)
                    else:
                        idx.append(None)
                yield r, range(at + 1, at + 1 + len(part)), idx, part, totals, None
                at += len(part)

    def parts_of(r: dict) -> Iterator[tuple]:
        try:
            yield from one(r)
        except FAULTS as e:
            if not errors:
                raise
            yield r, [None], [None], [None], (None, None), f"{type(e).__name__}: {e}"[:2000]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, size = [], 0, 0
        for b in batches:
            for r in b.to_pylist():
                for part in parts_of(r):
                    held.append(part)
                    n, size = n + len(part[3]), size + sum(len(x or "") for x in part[3])
                    if n >= BATCH_LINES or size >= BATCH_BYTES:
                        yield batch_of(held)
                        held, n, size = [], 0, 0
        if held:
            yield batch_of(held)

    return run


def raw_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, blk, value) of ranges (path, start, end): their lines, as they are."""
    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        of = pa.array([k for k, (_, _, v) in enumerate(held) for _ in v], pa.int32())
        out = [pa.array([p for p, _, _ in held], pa.string()).take(of), pa.array([s for _, s, _ in held], pa.int64()).take(of),
               pa.array([x for _, _, v in held for x in v], pa.string())]
        return pa.RecordBatch.from_arrays(out, names=["path", "blk", "value"])

    held, n, size = [], 0, 0
    for b in batches:
        for r in b.to_pylist():
            for lines in lines_of(r["path"], r["start"], r["end"]):
                for lo in range(0, len(lines), BATCH_LINES):
                    part = lines[lo:lo + BATCH_LINES]
                    held.append((r["path"], r["start"], part))
                    n, size = n + len(part), size + sum(map(len, part))
                    if n >= BATCH_LINES or size >= BATCH_BYTES:
                        yield batch_of(held)
                        held, n, size = [], 0, 0
    if held:
        yield batch_of(held)


def read_tails(max_bytes: int):
    """(path, text): the last ``max_bytes`` bytes of every file of (path); '' of one that can't be read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, texts, held = [], [], 0
            for path in b.column(0).to_pylist():
                try:
                    text = tail_of(path, max_bytes)
                except FAULTS:
                    text = ""
                paths.append(path)
                texts.append(text)
                held += len(text)
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string())], names=["path", "text"])
                    paths, texts, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string())], names=["path", "text"])

    return run


def faults(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, error) of the files of (path) that can't be read: opened, and of packed ones unpacked to their end."""
    for b in batches:
        paths, errors = [], []
        for path in b.column(0).to_pylist():
            try:
                system, name = file_system(path)
                codec = PACKED.get(name[name.rfind("."):].lower())
                if codec:
                    with system.open_input_stream(name, compression=codec) as f:
                        while f.read(BLOCK):
                            pass
                else:
                    with system.open_input_file(name) as f:
                        f.read(1)
            except FAULTS as e:
                paths.append(path)
                errors.append(f"{type(e).__name__}: {e}"[:2000])
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(errors, pa.string())], names=["path", "error"])
