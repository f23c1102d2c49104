"""Watching a log folder with Structured Streaming.

The stream is one of file versions (``sources.versions``): a file that is new, or has changed since it was last
seen, is a row. Each micro-batch reads those files whole, by byte ranges, and runs the batch triage on them, so a log that grows
is triaged again. The outbox rows of a batch are written under ``run=<query id>/batch_id=N``: overwritten
when that batch is replayed, so a retry does not duplicate alerts, and never by another
run. Offsets, the versions seen and the sink commit log live in the checkpoint folder, by default a folder
beside the output, so a restarted watch resumes where it stopped.

Failures are data (Z5). Files that can't be opened are set aside before the batch is read. A batch that fails all the same is tried
again, then halved and halved again, within ``JOBS`` jobs, until what fails is single logs. Logs that weren't reported go to
the ledger under ``_errors`` (path, attempt, again, error, timestamp); the stream gives them once more with the next batch, ``ATTEMPTS`` times in all, so
an outage leaves no log unreported, and a log that is bad ends as a row with ``again`` false.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.classify import severity_rank
from ..functions.regex import is_blank
from ..operators import report as RP
from ..operators.classify import classify
from ..plans.analyze import analyze, handing_on, release
from ..plans.triage import triage_table
from ..session import ensure_checkpoint_dir
from ..sources import ranges as BR
from ..sources.files import file_listing, file_ranges, job_column, plain_name, read_files, skip_tiny_lines
from ..sources.versions import stream_versions

OUTBOX = ["job_id", "recipient", "severity", "subject", "body"]
#: Times that a log is taken up, times that a batch is tried as it is, seconds between, and jobs spent on halving it.
ATTEMPTS = 3
TRIES = 2
PAUSE = 1.0
JOBS = 64


def stream_logs(spark: SparkSession, path: str, glob: str = "*.log",
                max_files_per_trigger: int | None = None, state: str | None = None) -> DataFrame:
    """New log files below ``path`` as a stream of raw lines (S4, Z1):
    path, blk (split start), value. A file that changes later is not read again; ``stream_versions`` tells of it.

    With ``state``, a folder of the stream's own that is kept as long as its checkpoint, files are found by ``stream_versions`` and read by
    byte ranges: paths are plain and lines are cut as ``read_logs`` cuts them. Spark's file source, used without it, in stores that only Spark opens and
    for ``max_files_per_trigger``, lists folders by a task each, several times a batch; its paths are URI-escaped."""
    if state and not max_files_per_trigger and BR.can_open(path) and BR.can_open(state):
        ranges = file_ranges(stream_versions(spark, plain_name(path), state, glob, once=True).select(
            F.lit("").alias("job_id"), F.lit("").alias("job_name"), "path", "size"))
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return ranges.select("path", "start", "end").repartition(n, "path", "start").mapInArrow(BR.raw_lines, "path string, blk bigint, value string")
    r = (spark.readStream.format("text").option("recursiveFileLookup", "true")
         .option("pathGlobFilter", glob))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.load(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("blk"),
        "value",
    )


def triage_batch(lines: DataFrame, as_of: str, rules=None, recipients: str | None = None,
                 severities=None, min_chars: int = R.MIN_LOG_CHARS) -> DataFrame:
    """Outbox rows for the logs of one batch: skip tiny logs, analyse, rule
    triage, gate, texts, recipients (Z2)."""
    kept = skip_tiny_lines(lines, min_chars)
    a = analyze(kept, rules, as_of=as_of, evidence_cap=R.EVIDENCE_CAP)
    alerts = RP.alert_text(RP.alert_gate(triage_table(a), severities))
    return handing_on(RP.alert_outbox(alerts, recipients or R.DEFAULT_RECIPIENTS).select(*OUTBOX), a)


def utc_now(spark: SparkSession) -> str:
    """The time as a UTC ISO stamp."""
    return spark.sql("SELECT date_format(to_utc_timestamp(current_timestamp(), current_timezone()), "
                     "\"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")").first()[0]


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a streaming query keeps over restarts, from its checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]


def unreadable(files: DataFrame) -> DataFrame:
    """(path, error) of the files of (path) that can't be opened, or aren't what their name says is packed in them."""
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("path").repartition(n, "path").mapInArrow(BR.faults, "path string, error string")


def watch_logs(spark: SparkSession, path: str, out: str, glob: str = "*.log",
               checkpoint: str | None = None, interval: str = "30 seconds",
               available_now: bool = False, as_of: str | None = None, job: str = "path",
               rules=None, recipients: str | None = None, severities=None):
    """Start the watch: every ``interval`` (or once over what is there with
    ``available_now``) triage the new and changed files and append alerts under ``out``. A job of several files
    (``job``) is read whole when one of them changes.
    The checkpoint is ``out/_checkpoint`` unless given, so a new start on the same output
    goes on where the last one stopped. Returns the StreamingQuery."""
    out = out.rstrip("/")
    checkpoint = (checkpoint or f"{out}/_checkpoint").rstrip("/")

    def triage(files: DataFrame, stamp: str, target: str) -> None:
        """Alerts of the jobs that ``files`` belong to."""
        session, listing, only = files.sparkSession, files, None
        if job != "path":
            listing = file_listing(session, path, glob)
            only = files.select(job_column(F.col("path"), job).alias("job_id"))
        rows = triage_batch(read_files(listing, job, only), stamp, rules, recipients, severities)
        try:
            rows.write.mode("overwrite").parquet(target)
        finally:
            release(rows)

    def halved(files: DataFrame, stamp: str, target: str) -> list[tuple[DataFrame, str]]:
        """What can be triaged of ``files`` is, part by part; the rest and why."""
        todo, left, jobs = [(files, 0, "")], [], 0
        while todo:
            part, depth, name = todo.pop(0)
            if jobs >= JOBS:
                left.append((part, "not tried: the batch failed too often"))
                continue
            jobs += 1
            try:
                triage(part, stamp, f"{target}/part={name or 'all'}")
            except Exception as e:
                n = part.limit(2).count()
                if n > 1 and depth < 48:
                    bit = F.shiftright(F.xxhash64("path"), depth) % 2
                    todo += [(half, depth + 1, f"{name}{b}") for b in (0, 1) if not (half := part.where(F.abs(bit) == b)).isEmpty()]
                elif n:
                    left.append((part, f"{type(e).__name__}: {e}"))
        return left

    def run(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        stamp, where = as_of or utc_now(session), f"run={query_id(session, checkpoint)}/batch_id={batch_id}"
        ensure_checkpoint_dir(session)
        files = batch.checkpoint()
        bad = unreadable(files).join(files, "path").select("path", "attempt", "error").checkpoint()
        good = files.join(bad.select("path"), "path", "left_anti")
        left: list[tuple[DataFrame, str]] = []
        for again in range(TRIES):
            try:
                triage(good, stamp, f"{out}/{where}")
                break
            except Exception:
                time.sleep(PAUSE * again)
        else:
            left = halved(good, stamp, f"{out}/{where}")
        ledger = bad
        for part, why in left:
            ledger = ledger.unionByName(part.select("path", "attempt", F.lit(why[:2000]).alias("error")))
        ledger = ledger.select("path", (F.col("attempt") + 1).alias("attempt"), (F.col("attempt") + 1 < ATTEMPTS).alias("again"), "error",
                               F.lit(stamp).alias("timestamp"))
        if not ledger.isEmpty():
            ledger.write.mode("overwrite").parquet(f"{out}/_errors/{where}")

    versions = stream_versions(spark, path, f"{checkpoint}/versions", glob, f"{out}/_errors")
    w = versions.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()


def read_errors(spark: SparkSession, out: str) -> DataFrame:
    """The ledger: the last word on every log that once failed (path, attempt, again, error, timestamp). A log whose last row says
    ``again`` was taken up since, or will be with the next batch."""
    rows = spark.read.schema("path string, attempt int, again boolean, error string, timestamp string").option(
        "recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{out.rstrip('/')}/_errors")
    last = F.max_by(F.struct("attempt", "again", "error", "timestamp"), F.struct("timestamp", "attempt"))
    return rows.groupBy("path").agg(last.alias("s")).select("path", "s.*")


def read_outbox(spark: SparkSession, out: str) -> DataFrame:
    """All alerts that the watch has written under ``out``."""
    return spark.read.schema("job_id string, recipient string, severity string, subject string, body string").option(
        "recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{out.rstrip('/')}")


def signal_counts(lines: DataFrame, rules=None) -> DataFrame:
    """Hits per (job, label): count and severity (the worst, if rules of one label differ). ``lines`` has job_id, value."""
    nb = lines.withColumn("idx", F.when(~is_blank(F.col("value")), F.lit(1)))
    # A label of a row that isn't deterministic: a filter on it alone is pushed below it, where every pattern runs twice.
    c = classify(nb, rules).withColumn("_once", F.spark_partition_id()).filter(F.col("label").isNotNull() & (F.col("_once") >= 0))
    return c.groupBy("job_id", "label").agg(F.count(F.lit(1)).alias("n"), _worst().alias("severity"))


def running_signal_counts(lines_stream: DataFrame, rules=None) -> DataFrame:
    """``signal_counts`` over a stream of lines (Z4), for update-mode sinks. Its state holds every (job, label) for
    ever; ``write_signal_counts`` keeps none."""
    return signal_counts(lines_stream, rules)


def _worst():
    return F.min_by("severity", F.struct(severity_rank(F.col("severity")), F.col("severity")))


def write_signal_counts(lines_stream: DataFrame, out: str, checkpoint: str | None = None, interval: str = "30 seconds",
                        available_now: bool = False, rules=None, compact_every: int = 50, expire: str | None = None):
    """Keep the signal counts of a stream of lines (job_id, value) as a table under ``out`` (Z4); read it with ``latest_signal_counts``.

    The stream has no state: each batch adds its own counts, under ``run=<query id>/batch_id=N``, overwritten
    when it is replayed. Every ``compact_every`` batches they are added to the last version, ``run=<query id>/version=N``, and what
    came before that one is removed. With ``expire`` (an interval such as "7 days"), jobs without a hit for so long leave the next version,
    so that the table follows the jobs that run.
    """
    out = out.rstrip("/")
    checkpoint = (checkpoint or f"{out}/_checkpoint").rstrip("/")

    def run(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        base = f"{out}/run={query_id(session, checkpoint)}"
        signal_counts(batch, rules).withColumn("seen", F.current_timestamp()).write.mode("overwrite").parquet(f"{base}/batch_id={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            rows = _counted(session, base, batch_id)
            if expire:
                alive = rows.groupBy("job_id").agg(F.max("seen").alias("_last")).where(
                    F.col("_last") >= F.current_timestamp() - F.expr(f"INTERVAL {expire}")).select("job_id")
                rows = rows.join(alive, "job_id", "left_semi")
            was = max((v for v in _numbers(session, base, "version") if v < batch_id), default=-1)
            rows.write.mode("overwrite").parquet(f"{base}/version={batch_id}")
            _remove(session, base, was)

    w = lines_stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()


COUNTS = "job_id string, label string, n bigint, severity string, seen timestamp"


def _folder(session: SparkSession, path: str):
    p = session._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(session._jsc.hadoopConfiguration()), p


def _numbers(session: SparkSession, base: str, kind: str) -> list[int]:
    """The N of the folders ``kind=N`` in ``base`` that were written to their end."""
    fs, p = _folder(session, base)
    names = [(st.getPath(), st.getPath().getName()) for st in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(name.partition("=")[2]) for at, name in names
                  if name.startswith(f"{kind}=") and fs.exists(session._jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS")))


def _remove(session: SparkSession, base: str, upto: int) -> None:
    """Batches up to a version, and versions before it: a reader may still be at the version itself."""
    for kind, most in (("batch_id", upto), ("version", upto - 1)):
        for n in _numbers(session, base, kind):
            if n <= most:
                fs, p = _folder(session, f"{base}/{kind}={n}")
                fs.delete(p, True)


def _counted(session: SparkSession, base: str, upto: int | None = None) -> DataFrame:
    """The counts of one run: its last version (before ``upto``), and the batches since (up to it)."""
    version = max((v for v in _numbers(session, base, "version") if upto is None or v < upto), default=-1)
    batches = [n for n in _numbers(session, base, "batch_id") if n > version and (upto is None or n <= upto)]
    paths = [f"{base}/version={version}"] * (version >= 0) + [f"{base}/batch_id={n}" for n in batches]
    rows = session.read.schema(COUNTS).parquet(*paths) if paths else session.createDataFrame([], COUNTS)
    return rows.groupBy("job_id", "label").agg(F.sum("n").alias("n"), _worst().alias("severity"), F.max("seen").alias("seen"))


def latest_signal_counts(spark: SparkSession, out: str) -> DataFrame:
    """(job_id, label, n, severity): the counts that ``write_signal_counts`` keeps under ``out``, of all its runs."""
    out = out.rstrip("/")
    fs, p = _folder(spark, out)
    runs = sorted(st.getPath().getName() for st in fs.listStatus(p) if st.getPath().getName().startswith("run="))
    every = spark.createDataFrame([], COUNTS)
    for run in runs:
        every = every.unionByName(_counted(spark, f"{out}/{run}"))
    return every.groupBy("job_id", "label").agg(F.sum("n").alias("n"), _worst().alias("severity"))
