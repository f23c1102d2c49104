"""Whole per-job analysis (P1): one analysis row per job.

``lines -> classify -> {job_context, signals, ranking, snippet, tail}``, each a
per-job aggregate, joined on job_id. All joins are between tables with one row
per job (or per job and label) that Spark has already hash-partitioned on the
job by their aggregates.
"""

from __future__ import annotations

import functools

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..operators.classify import classify, with_level_anywhere
from ..functions.lines import is_stack_line
from ..operators.context import CONTEXT_FLAGS, job_context, with_context_flags
from ..operators.signals import signal_rollup, signals
from ..operators.tail import error_subset, log_tail
from ..session import ensure_checkpoint_dir

CONTEXT_FIELDS = [
    "job_name", "platform", "spark_version", "total_log_lines", "error_count", "warn_count",
    "failed_stages", "executors_lost", "oom_events", "shuffle_failures", "task_retries",
]


def subset_lines(lines: DataFrame, rules=None, n: int = R.ERROR_SUBSET_LINES) -> DataFrame:
    """The Spark-path input: the first ``n`` error lines of each job,
    renumbered 1..k as the text they are re-read from."""
    lv = classify(with_level_anywhere(lines), rules)
    sub = error_subset(lv, n)
    from pyspark.sql import Window
    w = Window.partitionBy("job_id").orderBy("line_no")
    return sub.select("job_id", "value", F.row_number().over(w).alias("_k")).select(
        "job_id", F.col("_k").cast("bigint").alias("line_no"),
        F.col("_k").cast("bigint").alias("idx"), "value",
    )


def annotate(lines: DataFrame, rules=None) -> DataFrame:
    """Every per-line feature the analysis needs, in one projection: rule
    label / category / severity, job-context flags and the stack-line flag.
    Each regex runs once per line."""
    a = classify(lines, rules)
    a = with_context_flags(a)
    return a.withColumn("_stack", F.col("idx").isNotNull() & is_stack_line(F.col("value")))


def release(df: DataFrame) -> None:
    """Unpersist what ``analyze`` cached for ``df`` (call after its last
    action; a long-running session otherwise keeps the blocks)."""
    for c in getattr(df, "_logsieve_cached", []):
        c.unpersist()


def handing_on(out: DataFrame, *sources: DataFrame) -> DataFrame:
    """``out``, with which ``release`` frees what the frames it was derived from have cached."""
    out._logsieve_cached = [c for s in sources for c in getattr(s, "_logsieve_cached", [])]
    return out


def analyze_parts(lines: DataFrame, rules=None, materialize: str = "persist", evidence_cap: int | None = None,
                  stack_window: int = R.STACK_WINDOW, tail_lines: int = R.TAIL_LINES, snippet_signals: int = R.SNIPPET_SIGNALS,
                  snippet_evidence: int = R.SNIPPET_EVIDENCE, snippet_stack_chars: int = R.SNIPPET_STACK_CHARS) -> dict[str, DataFrame]:
    """The per-job pieces of an analysis, for reuse by other plans.

    The lines are read once. Only those that some piece is made of are kept, and of these only the texts that
    come back (``telling_lines``); lines that don't carry their job's total (``n_text``) are read twice more, for totals and tails.
    What is kept feeds several aggregates, so it is materialised once:
    ``"persist"`` caches it (memory, then local disk; lost blocks are
    recomputed from lineage), ``"checkpoint"`` writes it to the shared
    checkpoint folder of the session (cuts lineage: executor loss costs a
    re-read, not a recomputation), ``"none"`` recomputes per aggregate.
    """
    classified = telling_lines(annotate(lines, rules), tail_lines)
    if materialize == "persist":
        classified = classified.persist(StorageLevel.MEMORY_AND_DISK)
    elif materialize == "checkpoint":
        ensure_checkpoint_dir(classified.sparkSession)
        classified = classified.checkpoint(eager=True)
    elif materialize != "none":
        raise ValueError(f"unknown materialize {materialize!r}")
    sigs = signals(classified, evidence_cap, stack_window, persist=materialize == "none")
    context = job_context(classified)
    if "n_text" not in lines.columns:
        totals = lines.groupBy("job_id").agg(F.count("idx").alias("_total"))
        context = context.join(totals, "job_id").withColumn("total_log_lines", F.col("_total")).drop("_total")
    return {
        "classified": classified,
        "context": context,
        "signals": sigs,
        "rollup": signal_rollup(sigs, snippet_signals, snippet_evidence, snippet_stack_chars),
        "tail": log_tail(classified if "n_text" in lines.columns else lines, tail_lines),
    }


def telling_lines(annotated: DataFrame, tail_lines: int = R.TAIL_LINES) -> DataFrame:
    """The lines that an analysis is made of: classified, stack and tail lines with their text, lines with a context feature
    without it, and each job's first line, which stands for the job. All others go.

    The filter reads a column that is computed beside the features and isn't deterministic: so Spark can't push it
    below them, where every pattern would run twice."""
    quoted = F.col("label").isNotNull() | F.col("_stack")
    if "n_text" in annotated.columns:
        quoted = quoted | (F.col("idx") > F.col("n_text") - tail_lines)
    quoted = F.coalesce(quoted, F.lit(False))
    counted = [F.col(c) if c not in ("_version", "_platform", "_stage") else F.col(c).isNotNull() for c in CONTEXT_FLAGS]
    keep = functools.reduce(lambda a, b: a | b, counted, quoted | (F.col("line_no") == 1))
    once = annotated.withColumns({"value": F.when(quoted, F.col("value")), "_keep": keep, "_once": F.monotonically_increasing_id()})
    return once.filter(F.col("_keep") & (F.col("_once") >= 0)).drop("_keep", "_once")


def _with_all_jobs(ctx: DataFrame, jobs: DataFrame) -> DataFrame:
    """Context rows for every listed job; a job without lines (an empty log)
    gets zero counters, 'unknown' version and platform, no failed stages."""
    zero = F.lit(0).cast("bigint")
    return jobs.select(F.col("job_id").cast("string")).distinct().join(ctx, "job_id", "left").select(
        "job_id",
        F.coalesce("platform", F.lit("unknown")).alias("platform"),
        F.coalesce("spark_version", F.lit("unknown")).alias("spark_version"),
        *[F.coalesce(c, zero).alias(c) for c in ("total_log_lines", "error_count", "warn_count")],
        F.coalesce("failed_stages", F.array().cast("array<string>")).alias("failed_stages"),
        *[F.coalesce(c, zero).alias(c) for c in ("executors_lost", "oom_events", "shuffle_failures",
                                                 "task_retries")],
        *(["job_name"] if "job_name" in ctx.columns else []),
    )


def analyze(lines: DataFrame, rules=None, *, as_of: str, scope: str = "full", materialize: str = "persist",
            jobs: DataFrame | None = None, error_lines: int = R.ERROR_SUBSET_LINES, **limits) -> DataFrame:
    """One row per job: job_id, job_context (struct), primary_signal (struct or
    NULL), all_signals (array, rank order), raw_error_snippet, log_tail,
    timestamp.

    ``scope="full"`` triages every line (canonical). ``scope="error_subset"``
    reproduces the Spark path: only the first 150 error lines are triaged, the
    tail keeps blank lines and the total counts all lines.

    The time stamp ``as_of`` is the caller's. A ``job_name`` column of the lines (as ``read_logs`` gives)
    becomes the name in ``job_context``; else the job id is. ``limits`` are those of ``analyze_parts``: evidence
    lines per signal (``evidence_cap``; all by default), stack window, tail lines and snippet sizes.

    Jobs come from the lines; pass ``jobs`` (a table with job_id) to keep jobs
    whose log has no lines at all, as an empty log is still analysed.
    """
    if scope == "full":
        parts = analyze_parts(lines, rules, materialize, **limits)
        tail = parts["tail"]
        ctx = parts["context"]
    elif scope == "error_subset":
        # The source feeds three reads here (subset, tail, totals).
        if materialize == "persist":
            lines = lines.select(*[c for c in lines.columns if c in ("job_id", "job_name", "line_no", "idx", "value")]).persist(StorageLevel.MEMORY_AND_DISK)
        elif materialize == "checkpoint":
            ensure_checkpoint_dir(lines.sparkSession)
            lines = lines.select(*[c for c in lines.columns if c in ("job_id", "job_name", "line_no", "idx", "value")]).checkpoint(eager=True)
        source = lines
        parts = analyze_parts(subset_lines(lines, rules, error_lines), rules, materialize, **limits)
        tail = log_tail(lines, limits.get("tail_lines", R.TAIL_LINES), blank=True)
        named = ["job_name"] if "job_name" in lines.columns else []
        totals = lines.groupBy("job_id").agg(F.count(F.lit(1)).alias("_total"), *[F.min(c).alias(c) for c in named])
        # Jobs with no error line still get a context row.
        ctx = (
            totals.join(parts["context"], "job_id", "left")
            .select(
                "job_id",
                F.coalesce("platform", F.lit("unknown")).alias("platform"),
                F.coalesce("spark_version", F.lit("unknown")).alias("spark_version"),
                F.col("_total").alias("total_log_lines"),
                *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in
                  ("error_count", "warn_count")],
                F.coalesce("failed_stages", F.array().cast("array<string>")).alias("failed_stages"),
                *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in
                  ("executors_lost", "oom_events", "shuffle_failures", "task_retries")],
                *named,
            )
        )
    else:
        raise ValueError(f"unknown scope {scope!r}")
    if jobs is not None:
        ctx = _with_all_jobs(ctx, jobs)

    joined = ctx.join(parts["rollup"], "job_id", "left").join(tail, "job_id", "left")
    out = joined.select(
        "job_id",
        F.struct(
            (F.coalesce("job_name", "job_id") if "job_name" in ctx.columns else F.col("job_id")).alias("job_name"), "platform", "spark_version", "total_log_lines",
            "error_count", "warn_count", "failed_stages", "executors_lost", "oom_events",
            "shuffle_failures", "task_retries",
        ).alias("job_context"),
        F.col("primary").alias("primary_signal"),
        F.coalesce("all_signals", F.array().cast(
            "array<struct<label:string,category:string,severity:string,n:bigint,first_idx:bigint,"
            "evidence:array<string>,stack_trace:string>>")).alias("all_signals"),
        F.coalesce("raw_error_snippet", F.lit("")).alias("raw_error_snippet"),
        F.coalesce("log_tail", F.lit("")).alias("log_tail"),
        F.lit(as_of).alias("timestamp"),
    )
    out._logsieve_cached = [parts["classified"]] if materialize == "persist" else list(parts["signals"]._logsieve_cached)
    if scope == "error_subset" and materialize == "persist":
        out._logsieve_cached.append(source)
    return out


def flat_analysis(analysis: DataFrame) -> DataFrame:
    """Scalar columns of an analysis row (for tables, SQL and cross-checks)."""
    c = "job_context"
    return handing_on(analysis.select(
        "job_id",
        *[F.col(f"{c}.{f}").alias(f) for f in CONTEXT_FIELDS if f not in ("job_name", "failed_stages")],
        F.array_join(F.col(f"{c}.failed_stages"), ",").alias("failed_stages"),
        F.col("primary_signal.label").alias("primary_label"),
        F.col("primary_signal.category").alias("primary_category"),
        F.col("primary_signal.severity").alias("primary_severity"),
        F.size("all_signals").cast("bigint").alias("n_signals"),
        F.array_join(F.transform("all_signals", lambda s: F.concat(s["label"], F.lit("x"), s["n"].cast("string"))), ",").alias("signal_list"),
        "raw_error_snippet",
        "log_tail",
    ), analysis)
