"""Per-job aggregates: level counts, line totals and the job context (A1-A3).

Every aggregate here is a plain ``groupBy``: Spark combines map-side, so a
job with billions of lines ships one partial row per task, never its lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions.regex import is_blank, lowered


CONTEXT_FLAGS = ["_err", "_warn", "_version", "_platform", "_stage", "_lost", "_oom", "_shuffle", "_retry"]


def with_context_flags(lines: DataFrame) -> DataFrame:
    """Per-line job-context features (R7-R12), computed once per line; kept
    when already present (annotated lines)."""
    if "_err" in lines.columns:
        return lines
    v, low = F.col("value"), F.col("_low")
    return lines.withColumn("_low", lowered(v)).withColumns({
        "_err": L.is_error(v),
        "_warn": L.is_warn(v),
        "_version": L.spark_version(v, low),
        "_platform": L.platform(v, low),
        "_stage": L.failed_stage(v, low),
        "_lost": L.executor_lost(v, low),
        "_oom": L.oom(v, low),
        "_shuffle": L.shuffle_failure(v, low),
        "_retry": L.task_retry(v, low),
    }).drop("_low")


def level_stats(lines: DataFrame) -> DataFrame:
    """Lines per level (level found anywhere in the line), per job (A1)."""
    return (
        lines.select("job_id", L.level_anywhere(F.col("value")).alias("level"))
        .groupBy("job_id", "level")
        .agg(F.count(F.lit(1)).alias("n_lines"))
    )


def line_totals(lines: DataFrame) -> DataFrame:
    """Total lines (blank included) and non-blank lines per job (A2). Lines need no numbers."""
    return lines.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total_lines"),
        F.count_if(~is_blank(F.col("value"))).alias("nonblank_lines"),
    )


def failed_stages(lines: DataFrame) -> DataFrame:
    """Distinct failed stage ids per job, in first-seen order (A3).

    Stages are first reduced to (job, stage, first line) - one row per stage -
    and only that bounded set is collected per job.
    """
    stages = (
        with_context_flags(lines).select("job_id", "line_no", F.col("_stage").alias("stage"))
        .filter(F.col("stage").isNotNull())
        .groupBy("job_id", "stage")
        .agg(F.min("line_no").alias("first_line"))
    )
    return stages.groupBy("job_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("first_line", "stage"))), lambda s: s["stage"]
        ).alias("failed_stages")
    )


def job_context(lines: DataFrame) -> DataFrame:
    """One row per job: counters, first version and platform, failed stages.

    ``total_log_lines`` counts non-blank lines, as the analysis reports it.
    Jobs with no failed stage get an empty list. The lines are read once: a first
    aggregate by (job, stage named on the line) gives one row per stage, a second
    sums them up per job. Lines with a ``job_name`` column keep it. Lines that carry their job's total (``n_text``) need not
    all be there: those without any feature count nothing else.
    """
    total = "n_text" in lines.columns
    per_line = with_context_flags(lines)
    named = "job_name" in lines.columns
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("line_no", c))).alias(c)
    flags = ["_err", "_warn", "_lost", "_oom", "_shuffle", "_retry"]
    by_stage = per_line.groupBy("job_id", "_stage").agg(
        first("_platform"), first("_version"), (F.max("n_text") if total else F.count("idx")).alias("_n"), F.min("line_no").alias("_first"),
        *[F.count_if(c).alias(c) for c in flags], *([F.min("job_name").alias("job_name")] if named else []))
    stages = F.array_sort(F.collect_list(F.when(F.col("_stage").isNotNull(), F.struct("_first", "_stage"))))
    return by_stage.groupBy("job_id").agg(
        F.coalesce(F.min("_platform")["_platform"], F.lit("unknown")).alias("platform"),
        F.coalesce(F.min("_version")["_version"], F.lit("unknown")).alias("spark_version"),
        (F.max("_n") if total else F.sum("_n")).alias("total_log_lines"),
        F.sum("_err").alias("error_count"),
        F.sum("_warn").alias("warn_count"),
        F.transform(stages, lambda s: s["_stage"]).alias("failed_stages"),
        F.sum("_lost").alias("executors_lost"),
        F.sum("_oom").alias("oom_events"),
        F.sum("_shuffle").alias("shuffle_failures"),
        F.sum("_retry").alias("task_retries"),
        *([F.min("job_name").alias("job_name")] if named else []),
    )
