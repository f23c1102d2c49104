"""Log files and their metadata.

``read_logs`` moves no line. The listing is cut into byte ranges of fixed size, one row each. Only jobs of more than
one range need to know how many lines come before a range: theirs are counted, and prefix sums over the range rows
say where each range's numbers begin. The ranges, dealt to tasks by bytes, are then read and numbered where they are read. Large
logs are so read by many tasks, small ones once; a compressed log is one range, so one task.

Files of a store that only Spark opens go the older way (``number_files``): Spark's text reader, whose lines are
shuffled by split to be numbered.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.regex import WS, py_strip
from ..operators.numbering import number_lines
from ..session import ensure_checkpoint_dir
from . import ranges as BR

# Airflow task log layout: {base}/{dag_id}/{task_id}/{execution_date}/{try_number}.log
_AIRFLOW_LAYOUT = r"/([^/]+)/([^/]+)/([^/]+)/([^/]+)\.log$"


def file_stem(path: Column) -> Column:
    """``Path(p).stem``: last component without its last suffix."""
    name = F.substring_index(path, "/", -1)
    stem = F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)
    return F.when(stem == "", name).otherwise(stem)


def file_path(uri: Column) -> Column:
    """The plain name of a file from its URI form (``_metadata.file_path``): escapes are decoded,
    and ``file:`` with any number of slashes is dropped."""
    return plain_path(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))))


def plain_path(path: Column) -> Column:
    """A path without ``file:`` and its slashes, so that both ways Spark writes one are equal."""
    return F.regexp_replace(path, "^file:/+", "/")


def plain_name(path: str) -> str:
    """``plain_path`` of one path."""
    return re.sub("^file:/+", "/", path)


def job_from_path(df: DataFrame, path_col: str = "path") -> DataFrame:
    """Add job_id (file stem) and the Airflow layout fields (S6): dag_id,
    task_id, execution_date, try_number (NULL when the path does not follow
    the layout) and airflow_job = dag_id.task_id."""
    p = F.col(path_col)

    def part(i):
        return F.nullif(F.regexp_extract(p, _AIRFLOW_LAYOUT, i), F.lit(""))

    return df.withColumns({
        "job_id": file_stem(p),
        "dag_id": part(1),
        "task_id": part(2),
        "execution_date": part(3),
        "try_number": part(4),
        "airflow_job": F.concat_ws(".", part(1), part(2)),
    })


def job_column(path: Column, job: str = "path") -> Column:
    """Job key of a log file: 'path' (the file: every file is a log of its own,
    whatever its name), 'dir' (the parent folder; a ``key=value`` folder gives
    value, for logs rolled into several files per job), or 'stem' (the file name without
    suffix, which makes one job of equally named files)."""
    if job == "stem":
        return file_stem(path)
    if job == "path":
        return path
    if job == "dir":
        d = F.regexp_extract(F.substring_index(path, "/", -2), r"^([^/]+)/", 1)  # a search from the path's start tries every character
        return F.regexp_replace(d, r"^[^=]*=", "")
    raise ValueError(f"unknown job key {job!r}")


def job_name(job_id: Column, path: Column, job: str) -> Column:
    """What a job is called: the stem of its file; of several files, the job key."""
    return file_stem(path) if job == "path" else job_id


LINE_COLUMNS = ["job_id", "job_name", "path", "line_no", "idx", "value", "n_text", "n_chars"]
LINE_SCHEMA = "job_id string, job_name string, path string, line_no bigint, idx bigint, value string, n_text bigint, n_chars bigint"


def number_files(raw: DataFrame, job: str = "path", only: DataFrame | None = None) -> DataFrame:
    """A lines table from rows (path, blk, mid, value) as a text reader gives them.
    ``only``: the job_ids to keep; other rows go before lines are numbered."""
    raw = raw.withColumn("job_id", job_column(F.col("path"), job))
    if only is not None:
        raw = raw.join(only, "job_id", "left_semi")
    numbered = number_lines(raw, keys=["job_id"], chunk=F.struct("path", "blk"), order=[F.col("mid")])
    return numbered.withColumn("job_name", job_name(F.col("job_id"), F.col("path"), job)).select(*[c for c in LINE_COLUMNS if c != "n_chars"])


#: Bytes of a range, and of the ranges that one task reads; tasks of a core that may read less than these.
RANGE_BYTES = 32 << 20
TASK_BYTES = 64 << 20
SMALL_TASKS = 64


def read_logs(spark: SparkSession, path: str | list[str], glob: str = "*.log", job: str = "path", modified_after: str | None = None,
              only: DataFrame | None = None, reader: str | None = None, **how) -> DataFrame:
    """All log files below ``path`` matching ``glob`` as a lines table (S1):
    job_id, job_name, path, line_no, idx, value (see ``job_column`` for ``job``), n_text (the job's non-blank lines), n_chars (the length of its stripped text; not from Spark's reader). Paths
    and names are plain, not URI-escaped. ``modified_after`` prunes older files at listing;
    ``only`` (job_id) keeps the jobs named there.

    Lines are numbered per job in (file path, position) order; with one file
    per job that is the file's own line order. ``reader``: "ranges" (``read_files``, which takes ``how``) or "spark"
    (Spark's text reader); by default ranges wherever they can be opened."""
    paths = [path] if isinstance(path, str) else list(path)
    if reader not in (None, "ranges", "spark"):
        raise ValueError(f"unknown reader {reader!r}")
    if reader == "ranges" or reader is None and all(map(BR.can_open, paths)):
        return read_files(file_listing(spark, paths, glob, modified_after), job, only, **how)
    r = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    if modified_after:
        r = r.option("modifiedAfter", modified_after)
    return number_files(r.text(paths).select(
        file_path(F.col("_metadata.file_path")).alias("path"),
        F.col("_metadata.file_block_start").alias("blk"),
        F.monotonically_increasing_id().alias("mid"),
        "value",
    ), job, only)


def file_ranges(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(job_id, job_name, path, start, end) for every byte range of ``files`` (job_id, job_name, path, size)."""
    cut = F.when(F.col("path").rlike(BR.PACKED_PATTERN), F.col("size")).otherwise(F.lit(range_bytes))
    return files.where(F.col("size") > 0).select(
        "job_id", "job_name", "path", "size", cut.alias("_cut"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, cut)).alias("start")
    ).select("job_id", "job_name", "path", "start", F.least(F.col("start") + F.col("_cut"), "size").alias("end"))


def read_files(listing: DataFrame, job: str = "path", only: DataFrame | None = None, range_bytes: int = RANGE_BYTES,
               task_bytes: int = TASK_BYTES, errors: bool = False) -> DataFrame:
    """The lines table of the files of ``listing`` (path, size): ``read_logs`` by byte ranges.

    The listing is kept in the shared checkpoint folder, so that lines are counted and read of the same ranges. With ``errors``
    a file that can't be read is a row without a line, whose column ``error`` says why, and the others are read as ever.

    Tasks read ``task_bytes`` each; where that is less than TASK_BYTES, there are no more than SMALL_TASKS a core of them, as starting
    them would take longer than reading, and they read more.
    """
    p = F.col("path")
    files = listing.select("path", F.col("size").cast("long").alias("size")).withColumn("job_id", job_column(p, job))
    if only is not None:
        files = files.join(only.select("job_id").distinct(), "job_id", "left_semi")
    files = files.withColumn("job_name", job_name(F.col("job_id"), p, job))
    ensure_checkpoint_dir(listing.sparkSession)
    ranges = file_ranges(files, range_bytes).checkpoint()
    size, n = ranges.agg(F.sum(F.col("end") - F.col("start")), F.count(F.lit(1))).first()
    tasks = _tasks(size or 0, n, task_bytes, listing.sparkSession.sparkContext.defaultParallelism)
    # A range that is its whole job counts itself; packed ones, of unknown length, don't.
    many = ranges.groupBy("job_id").agg(F.count(F.lit(1)).alias("_n"), F.bool_or(F.col("path").rlike(BR.PACKED_PATTERN)).alias("_p")).where(
        "_n > 1 OR _p").select("job_id")
    of_many = ranges.join(many, "job_id", "left_semi")
    # A job's ranges meet to be summed up: one narrow row for each, no line.
    counts = of_many.select("path", "start", "end").repartition(tasks, "path", "start").mapInArrow(
        BR.count_lines(errors), BR.COUNTED)
    whole = Window.partitionBy("job_id")
    before = whole.orderBy("path", "start").rowsBetween(Window.unboundedPreceding, -1)
    starts = of_many.select("job_id", "path", "start").join(counts, ["path", "start"]).withColumn(
        "_at", F.coalesce(F.sum("size").over(before), F.lit(0))).select(
        "path", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lines"), F.coalesce(F.sum("n_text").over(before), F.lit(0)).alias("texts"),
        F.sum("n_text").over(whole).alias("n_text"),
        F.coalesce(F.max(F.col("_at") + F.col("last")).over(whole) - F.min(F.col("_at") + F.col("first")).over(whole), F.lit(0)).alias("n_chars"))
    dealt = ranges.join(starts, ["path", "start"], "left").select(
        "job_id", "job_name", "path", "start", "end", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("lines", "texts")], "n_text", "n_chars")
    return dealt.repartition(tasks, "path", "start").mapInArrow(
        BR.number_lines_of(errors), LINE_SCHEMA + (", error string" if errors else ""))


def _tasks(size: int, n: int, task_bytes: int, cores: int) -> int:
    """Tasks that read ``n`` ranges of ``size`` bytes in all."""
    return max(1, min(-(-size // task_bytes), max(-(-size // TASK_BYTES), SMALL_TASKS * cores)), min(n, cores))


def tail_files(files: DataFrame, max_bytes: int = R.TAIL_BYTES) -> DataFrame:
    """(path, text): the last ``max_bytes`` bytes of every file of ``files`` (path), decoded as UTF-8 with U+FFFD for what isn't.

    Each file is opened where its row is, and only its last bytes are read; one that can't be read gives ''.
    """
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("path").distinct().repartition(n, "path").mapInArrow(BR.read_tails(max_bytes), "path string, text string")


def write_log_files(lines: DataFrame, out: str, mode: str = "overwrite") -> None:
    """Write a lines table as text log files: one folder per job
    (``job_id=<job>``), lines in order. Range partitioning on (job, line)
    lets a large job span several files, named in line order."""
    write_folders(lines.select("job_id", "line_no", "value")
                  .repartitionByRange("job_id", "line_no")
                  .sortWithinPartitions("job_id", "line_no"), out, ["job_id"], mode)


def write_folders(lines: DataFrame, out: str, keys: list[str], mode: str = "overwrite") -> None:
    """Lines (keys, value), sorted by their keys, as text files in folders ``key=value/...`` as ``partitionBy`` names them.

    Each task writes its files and names them when they are whole; ``_SUCCESS`` says that all are. Spark's committer would move every
    folder from the driver, one after the other; it is used only in stores that only Spark opens."""
    spark, lines = lines.sparkSession, lines.select(*[F.col(k).cast("string").alias(k) for k in keys], "value")
    if not BR.can_open(out):
        lines.write.mode(mode).partitionBy(*keys).text(out)
        return
    folder = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if mode not in ("overwrite", "append", "ignore", "error", "errorifexists"):
        raise ValueError(f"unknown mode {mode!r}")
    if fs.exists(folder):
        if mode == "ignore":
            return
        if mode.startswith("error"):
            raise ValueError(f"{out} exists")
        if mode == "overwrite":
            fs.delete(folder, True)
    fs.mkdirs(folder)
    lines.mapInArrow(BR.write_folders(out, keys, uuid.uuid4().hex), "n bigint").count()
    fs.create(spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS"), True).close()


#: Folders that one task lists, and tasks of a core that list many: starting one takes as long as listing thousands of folders of a disk.
TASK_FOLDERS = 200
LISTING_TASKS = 4


def file_listing(spark: SparkSession, path: str | list[str], glob: str = "*.log", modified_after: str | None = None) -> DataFrame:
    """(path, mtime, size) of the files below ``path`` that aren't empty; file content is not read.

    Folders are listed level by level, by tasks, and what is found is kept in the shared checkpoint folder: the driver holds no list,
    however many files there are. Paths with wildcards, and stores that only Spark opens, go by Spark's own listing.
    """
    paths = list(dict.fromkeys([path] if isinstance(path, str) else path))
    if not all(BR.can_open(p) and not re.search(r"[{}\[\]*?\\]", p) and BR.exists(p) for p in paths):
        return _listing_by_spark(spark, path, glob, modified_after)
    ensure_checkpoint_dir(spark)
    level, n, out = spark.createDataFrame([(plain_name(p),) for p in paths], "path string"), len(paths), None
    while n:
        tasks = min(-(-n // TASK_FOLDERS), LISTING_TASKS * spark.sparkContext.defaultParallelism)
        found = level.repartition(tasks, "path").mapInArrow(BR.list_folders(glob), BR.LISTED).checkpoint()
        files = found.where(~F.col("folder")).select("path", "mtime", "size")
        out = files if out is None else out.unionByName(files)
        level = found.where("folder").select("path")
        n = level.count()
    if len(paths) > 1:  # one may be below another
        out = out.dropDuplicates(["path"])
    return out if modified_after is None else out.where(F.col("mtime") > F.lit(modified_after).cast("timestamp"))


def _listing_by_spark(spark: SparkSession, path: str | list[str], glob: str, modified_after: str | None = None) -> DataFrame:
    """``file_listing`` by Spark's binaryFile reader, whose content column is pruned from the scan."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    if modified_after:
        r = r.option("modifiedAfter", modified_after)
    return (
        r.load(path)
        .select(plain_path(F.col("path")).alias("path"), F.col("modificationTime").alias("mtime"),
                F.col("length").alias("size"))
    )


def changed_files(listing: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files that are new or whose mtime grew since the manifest (S3), and the
    upserted manifest (max mtime per path). Both inputs: (path, mtime)."""
    l = listing.select("path", F.col("mtime").alias("_new"))
    m = manifest.select("path", F.col("mtime").alias("_old"))
    changed = (
        l.join(m, "path", "left")
        .filter(F.col("_old").isNull() | (F.col("_old") < F.col("_new")))
        .select("path", F.col("_new").alias("mtime"))
    )
    new_manifest = (
        listing.select("path", "mtime").unionByName(manifest.select("path", "mtime"))
        .groupBy("path").agg(F.max("mtime").alias("mtime"))
    )
    return changed, new_manifest


def decode_cut(b: Column) -> Column:
    """Decode UTF-8 bytes whose start may cut a character: each leading
    continuation byte (at most three) becomes U+FFFD, as Python's
    ``errors="replace"`` does; the rest is whole characters."""
    def cont(i):
        x = F.conv(F.hex(F.substring(b, i, 1)), 16, 10).cast("int")
        return (x >= 128) & (x < 192)

    k = F.when(cont(1), F.when(cont(2), F.when(cont(3), F.lit(3)).otherwise(F.lit(2))).otherwise(F.lit(1))) \
        .otherwise(F.lit(0))
    rest = F.substring(b, k + 1, F.octet_length(b))
    return F.concat(F.repeat(F.lit("\ufffd"), k), F.decode(rest, "UTF-8"))


def tail_bytes(text: Column, max_bytes: int = R.TAIL_BYTES) -> Column:
    """The last ``max_bytes`` bytes of a text, decoded again as UTF-8 (S8);
    the first character may be cut and is then replaced."""
    b = F.encode(text, "UTF-8")
    return F.when(F.octet_length(text) <= max_bytes, text).otherwise(
        decode_cut(F.substring(b, -max_bytes, max_bytes)))


def stripped_length(text: Column) -> Column:
    return F.length(py_strip(text)).cast("bigint")


def skip_tiny(df: DataFrame, text_col: str = "text", min_chars: int = R.MIN_LOG_CHARS) -> DataFrame:
    """Logs whose stripped text has at least ``min_chars`` characters."""
    return df.filter(stripped_length(F.col(text_col)) >= min_chars)


def skip_tiny_lines(lines: DataFrame, min_chars: int = R.MIN_LOG_CHARS) -> DataFrame:
    """``skip_tiny`` on a lines table: keep the jobs whose text, stripped of
    outer whitespace, is at least ``min_chars`` long (lines joined by one
    newline).

    Lines that carry that length (``n_chars``) need nothing else. Of the others,
    the sum of the stripped lines' lengths, one map-side aggregate, is a lower bound and decides nearly all
    jobs; only jobs below it that hold any text at all are measured exactly.
    """
    if "n_chars" in lines.columns:
        return lines.filter(F.col("n_chars") >= min_chars)
    least = lines.groupBy("job_id").agg(F.sum(stripped_length(F.col("value"))).alias("_least"))
    sure = least.filter(F.col("_least") >= min_chars).select("job_id")
    open_ = least.filter((F.col("_least") > 0) & (F.col("_least") < min_chars)).select("job_id")
    exact = _stripped_sizes(lines.join(open_, "job_id", "left_semi")).filter(F.col("_len") >= min_chars).select("job_id")
    return lines.join(sure.unionByName(exact), "job_id", "left_semi")


def _stripped_sizes(lines: DataFrame) -> DataFrame:
    """(job_id, _len): length of each job's text without its outer whitespace."""
    nb = F.col("idx").isNotNull()
    bounds = lines.groupBy("job_id").agg(
        F.min(F.when(nb, F.col("line_no"))).alias("_first"),
        F.max(F.when(nb, F.col("line_no"))).alias("_last"),
        F.min_by(F.length(F.regexp_extract("value", f"(?U)^({WS}*)", 1)),
                 F.when(nb, F.col("line_no"))).alias("_lead"),
        F.max_by(F.length(F.regexp_extract("value", f"(?U)({WS}*)\\z", 1)),
                 F.when(nb, F.col("line_no"))).alias("_trail"),
    ).filter(F.col("_first").isNotNull())
    inner = lines.join(bounds, "job_id").filter(
        (F.col("line_no") >= F.col("_first")) & (F.col("line_no") <= F.col("_last"))
    )
    return inner.groupBy("job_id").agg(
        (F.sum(F.length("value")) + F.max(F.col("_last") - F.col("_first"))
         - F.max("_lead") - F.max("_trail")).alias("_len"))


def tail_bytes_lines(lines: DataFrame, max_bytes: int = R.TAIL_BYTES,
                     chunk_lines: int = 4096) -> DataFrame:
    """The last ``max_bytes`` bytes of each log held as a lines table (S8),
    as text per job: ``job_id, text``.

    The file is taken to be the lines, each ended by one newline. Bytes are summed per chunk of
    ``chunk_lines`` lines (a map-side partial aggregate); the chunks that reach into the last
    ``max_bytes`` are kept, and only their lines move on: inside them, the bytes after each line decide.
    The first line kept is cut to its last bytes and decoded again (a cut character becomes
    U+FFFD). What is gathered per job is bounded by ``max_bytes``.
    """
    b = (F.octet_length("value") + F.lit(1)).cast("long")
    df = lines.select("job_id", "line_no", "value", b.alias("_b"),
                      F.floor((F.col("line_no") - 1) / F.lit(chunk_lines)).alias("_chunk"))
    sizes = df.groupBy("job_id", "_chunk").agg(F.sum("_b").alias("_cb"))
    later = Window.partitionBy("job_id").orderBy(F.col("_chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    last = sizes.select("job_id", "_chunk", F.coalesce(F.sum("_cb").over(later), F.lit(0)).alias("_after")) \
        .filter(F.col("_after") < max_bytes)
    inside = Window.partitionBy("job_id", "_chunk").orderBy(F.col("line_no").desc()).rowsBetween(Window.unboundedPreceding, -1)
    j = df.join(last, ["job_id", "_chunk"])
    after = F.col("_after") + F.coalesce(F.sum("_b").over(inside), F.lit(0))  # bytes after this line
    keep = F.lit(max_bytes) - F.col("_rest")                         # bytes of this line (+ newline) kept
    cut = F.when(keep - 1 <= 0, F.lit("")).otherwise(
        decode_cut(F.substring(F.encode("value", "UTF-8"), -(keep - 1), keep - 1)))
    kept = j.withColumn("_rest", after).filter(F.col("_rest") < F.lit(max_bytes)).select(
        "job_id", "line_no", F.when(keep >= F.col("_b"), F.col("value")).otherwise(cut).alias("value"))
    return kept.groupBy("job_id").agg(
        F.concat(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "value"))),
                                     lambda s: s["value"]), "\n"),
            F.lit("\n"),
        ).alias("text")
    )
