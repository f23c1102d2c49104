"""Failure-callback triage as a batch join.

failure contexts -> normalise (S10) -> locate the task log (S7) -> take its
last bytes (S8) or a fallback text (S9) -> lines -> analyse -> rule triage ->
notes enriched with the context (T6) -> alert flag (R14).
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules as R
from ..operators import report as RP
from ..sources import airflow as AF
from ..sources.files import file_listing, read_logs, tail_bytes, tail_bytes_lines, tail_files
from ..sources.ranges import can_open
from ..sources.text import lines_from_text
from .analyze import analyze, handing_on


def triage_failures(failures: DataFrame, files: DataFrame, base: str, as_of: str,
                    notify=("HIGH", "CRITICAL"), rules=None, key: str = "failure_id") -> DataFrame:
    """One triage row per failure: the triage columns with job_id = failure
    key, job_name = dag_id.task_id, and ``alert``: whether it is sent.

    ``files`` is (path, text) of the readable task logs; its paths are the
    listing. The callback forces an alert when the severity is in ``notify``,
    so the gate is that set together with the default alert severities.
    """
    ctx = _contexts(failures, as_of, key)
    located = AF.locate_logs(ctx, files, base, key=key)
    return _triaged(ctx, located, files.select("path", tail_bytes(F.col("text")).alias("text")), as_of, notify, rules, key)


def triage_failures_in_folder(spark: SparkSession, failures: DataFrame, base: str, as_of: str, notify=("HIGH", "CRITICAL"),
                              rules=None, key: str = "failure_id", glob: str = "*.log", max_bytes: int = R.TAIL_BYTES) -> DataFrame:
    """``triage_failures`` over the task-log folder ``base`` itself: it is listed, and of the logs located for a
    failure the last ``max_bytes`` bytes are read, whatever their size. (In a store that only Spark opens, those
    logs are read whole as lines and their ends are put together again.)"""
    ctx = _contexts(failures, as_of, key)
    located = AF.locate_logs(ctx, file_listing(spark, base, glob), base, key=key)
    needed = located.where(F.col("log_path").isNotNull()).select(F.col("log_path").alias("path")).distinct()
    if can_open(base):
        tails = tail_files(needed, max_bytes)
    else:
        lines = read_logs(spark, base, glob, only=needed.withColumnRenamed("path", "job_id"))
        tails = tail_bytes_lines(lines, max_bytes).select(F.col("job_id").alias("path"), "text")
    return _triaged(ctx, located, tails, as_of, notify, rules, key)


def _contexts(failures: DataFrame, as_of: str, key: str) -> DataFrame:
    """One row per failure, read by three steps: persisted once."""
    ctx = AF.failure_context(failures, as_of, keep=[key]).persist(StorageLevel.MEMORY_AND_DISK)
    ctx._logsieve_cached = [ctx]
    return ctx


def _triaged(ctx: DataFrame, located: DataFrame, texts: DataFrame, as_of: str, notify, rules, key: str) -> DataFrame:
    lines = lines_from_text(AF.resolve_log_text(located, texts), key, "log_text")
    a = analyze(lines, rules, as_of=as_of, evidence_cap=R.EVIDENCE_CAP)
    ctx_k = ctx.withColumnRenamed(key, "job_id")
    tri = RP.enrich_notes(RP.rule_triage(a), ctx_k, on="job_id")
    names = ctx_k.select("job_id", F.concat_ws(".", "dag_id", "task_id").alias("job_name"))
    gate = list(dict.fromkeys(list(notify) + R.DEFAULT_ALERT_SEVERITIES))
    out = tri.join(names, "job_id", "left").withColumn("alert", F.col("severity").isin(gate))
    return handing_on(out, a, ctx)
