"""Test inputs derived from the given tables: a log corpus from ``events``, failure contexts and their logs.

The registered queries and the tests use them; they are no sources for users.

Each event becomes a block of one to four log lines chosen by
``event_id % 24``; the job is ``'job_' || user_id``; lines of a job are ordered
by (ts, event_id, position in block). The rendering is a pure function of the
events, so any SQL engine can produce the same lines for a cross-check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import number_lines
from ..sources.airflow import DAG_RUN_TYPE, TI_TYPE, candidate_paths

# FIXED VALUES: block templates by event_id % 24 ('@' = timestamp, '#' = event_id % 7).
BLOCK_TEMPLATES: list[str] = [
    "@ INFO SparkContext: Running Spark version 3.5.1 on Kubernetes",
    "@ ERROR Executor: task hit a limit\njava.lang.OutOfMemoryError: Java heap space\n"
    "\tat org.acme.Sort.grow(Sort.java:#)\n\tat org.acme.Sort.insert(Sort.java:1#)",
    "@ ERROR ObjectStore: read failed\nAmazonS3Exception: AccessDenied (status 403)\n"
    "\tat org.acme.Store.get(Store.java:2#)\nCaused by: java.io.IOException: denied",
    "@ ERROR Scheduler: Lost executor # on host-#",
    "@ ERROR ShuffleBlockFetcherIterator: cannot fetch block #\n\n\tat org.acme.Fetch.run(Fetch.java:3#)",
    "@ WARN Client: slow call\njava.net.SocketTimeoutException: Read timed out",
    "@ FATAL DiskStore: No space left on device",
    "@ ERROR Driver: crash handler started",
    "@ ERROR DAGScheduler: Stage # failed after 4 attempts",
    "@ WARN Hive: metastore call slow",
    "@ ERROR Closure: Task not serializable",
    "org.apache.spark.sql.AnalysisException: column c# missing",
    "@ ERROR Bridge: py4j.protocol.Py4JError: call failed",
    "@ ERROR Tls: certificate check error",
    "@ WARN Node: spot instance interrupt notice",
    "@ WARN Client: Retrying task fetch, retry #",
]
OTHER_TEMPLATE = "@ INFO Job: step # done"
BLOCK_MODULUS = 24
TS_FORMAT = "yy/MM/dd HH:mm:ss"


def _template(k):
    expr = None
    for i, t in enumerate(BLOCK_TEMPLATES):
        expr = F.when(k == i, F.lit(t)) if expr is None else expr.when(k == i, F.lit(t))
    return expr.otherwise(F.lit(OTHER_TEMPLATE))


def block_text():
    """The rendered block of an event row (lines joined by newlines)."""
    k = F.col("event_id") % BLOCK_MODULUS
    return F.replace(
        F.replace(_template(k), F.lit("@"), F.date_format("ts", TS_FORMAT)),
        F.lit("#"),
        (F.col("event_id") % 7).cast("string"),
    )


def render_blocks(events: DataFrame) -> DataFrame:
    """One row per event line: job_id, ts, event_id, pos, value (unnumbered)."""
    block = block_text()
    return events.select(
        F.concat(F.lit("job_"), F.col("user_id").cast("string")).alias("job_id"),
        "ts",
        "event_id",
        F.posexplode(F.split(block, "\n", -1)).alias("pos", "value"),
    )


# Chunk statistics per logical plan. The width only sizes chunks: a stale
# entry (files changed under the same path) can change task sizes, never results.
_CHUNK_STATS: dict = {}


def time_chunk(events: DataFrame, rows_per_chunk: int = 1_000_000, ts: str = "ts"):
    """A chunk column monotone in ``ts``: seconds since the first event, cut
    into slices that hold ``rows_per_chunk`` events on average over the whole
    table. A job with a third of all events is spread over many slices; a
    small table is one slice.

    The start and width come from one global aggregate over the ``ts``
    column, run once here (a one-row result). As a scalar subquery Spark
    planned a separate scan for every reference to it."""
    key = (events.semanticHash(), rows_per_chunk, ts)
    st = _CHUNK_STATS.get(key)
    if st is None:
        lo, hi, n = F.min(ts), F.max(ts), F.count(F.lit(1))
        span = F.timestamp_diff("SECOND", lo, hi) + 1
        width = F.greatest(F.lit(1), F.ceil(span * F.lit(rows_per_chunk) / F.greatest(n, F.lit(1))))
        st = events.agg(lo.alias("lo"), width.cast("long").alias("width")).first()
        if len(_CHUNK_STATS) > 256:
            _CHUNK_STATS.clear()
        _CHUNK_STATS[key] = st
    if st is None or st["lo"] is None:
        return F.lit(0).cast("long")
    # Any start keeps the column monotone; the NTZ literal keeps it exact.
    since = F.timestamp_diff("SECOND", F.expr(f"TIMESTAMP_NTZ'{st['lo'].isoformat(sep=' ')}'"), F.col(ts))
    return F.floor(since / F.lit(int(st["width"])))


def render_corpus(events: DataFrame, rows_per_chunk: int = 1_000_000) -> DataFrame:
    """``lines``: job_id, line_no, idx, value, n_text - numbered exactly per job.

    Numbering is chunked by time slices (``time_chunk``) so a job with a huge
    share of the events is spread over many tasks (see ``number_lines``).
    """
    blocks = render_blocks(events)
    numbered = number_lines(
        blocks,
        keys=["job_id"],
        chunk=time_chunk(events, rows_per_chunk),
        order=[F.col("ts"), F.col("event_id"), F.col("pos")],
    )
    return numbered.select("job_id", "line_no", "idx", "value", "n_text")


def render_failures(events: DataFrame) -> DataFrame:
    """Failure contexts derived from the ``events`` rows of type 'error'.

    Every fifth failure carries its task instance under ``ti`` instead of
    ``task_instance``; every seventh has no dag_run; every fourth has no
    exception text. The exception is the event's rendered log block.
    """
    e = events.filter(F.col("event_type") == "error").withColumn("_exc", block_text())
    eid = F.col("event_id")
    date = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    ti = F.struct(
        F.concat(F.lit("dag_"), (F.col("user_id") % 10).cast("string")).alias("dag_id"),
        F.concat(F.lit("task_"), (eid % 3).cast("string")).alias("task_id"),
        date.alias("execution_date"),
        ((eid % 3) + 1).cast("int").alias("try_number"),
        F.lit("SparkSubmitOperator").alias("operator"),
        F.concat(F.lit("worker-"), (eid % 4).cast("string")).alias("hostname"),
        F.concat(F.lit("http://logs/"), eid.cast("string")).alias("log_url"),
    ).cast(TI_TYPE)
    dag_run = F.struct(
        F.concat(F.lit("dag_"), (F.col("user_id") % 10).cast("string")).alias("dag_id"),
        F.concat(F.lit("run_"), eid.cast("string")).alias("run_id"),
        date.alias("execution_date"),
    ).cast(DAG_RUN_TYPE)
    return e.select(
        eid.cast("string").alias("failure_id"),
        F.when(eid % 5 != 0, ti).alias("task_instance"),
        F.when(eid % 5 == 0, ti).alias("ti"),
        F.when(eid % 7 != 0, dag_run).alias("dag_run"),
        F.when(eid % 4 != 0, F.col("_exc")).alias("exception"),
    )


def render_log_files(contexts: DataFrame, base: str) -> DataFrame:
    """One log file (path, text) per context: a third at the first candidate
    path, a third at the second, and a third under the next try number (a
    later attempt's log, which the locator must not take); every eleventh
    file is empty."""
    k = F.col("failure_id").cast("bigint")
    c = contexts.select("*", candidate_paths(base).alias("_c"),
                        candidate_paths(base, F.col("try_number") + 1)[0]["path"].alias("_later"))
    return c.select(
        F.when(k % 3 == 0, F.col("_c")[0]["path"]).when(k % 3 == 1, F.col("_c")[1]["path"])
        .otherwise(F.col("_later")).alias("path"),
        F.when(k % 11 == 0, F.lit("")).otherwise(F.coalesce("exception", F.lit(""))).alias("text"),
    )


# FIXED VALUES: what fills a rendered task log up, so that its last bytes are cut.
FILLER, FILLER_TIMES = "filler INFO line of a long log\n", 50


def render_task_logs(contexts: DataFrame, base: str) -> DataFrame:
    """(path, text): ``render_log_files``, one text a path, each that isn't empty longer than a short tail: after many lines
    that say nothing. Every second has \\r\\n line ends; none ends its last line."""
    files = render_log_files(contexts, base).groupBy("path").agg(F.max("text").alias("text"))
    long = F.concat(F.repeat(F.lit(FILLER), FILLER_TIMES), "text")
    crlf = F.regexp_extract("path", r"(\d+)\.log$", 1).cast("int") % 2 == 0
    return files.select("path", F.when(F.col("text") == "", "").when(crlf, F.replace(long, F.lit("\n"), F.lit("\r\n"))).otherwise(long).alias("text"))


def write_text_files(files: DataFrame) -> None:
    """The files (path, text), byte for byte, in folders that the executors share."""
    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        for b in batches:
            for r in b.to_pylist():
                system, name = fs.LocalFileSystem(), r["path"]
                system.create_dir(name.rpartition("/")[0], recursive=True)
                with system.open_output_stream(name, compression=None) as f:
                    f.write(r["text"].encode())
        yield pa.RecordBatch.from_pylist([], schema=pa.schema([("n", pa.int64())]))

    files.mapInArrow(run, "n bigint").count()
