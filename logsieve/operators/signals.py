"""Failure signals per (job, label): counts, evidence, stacks, ranking.

Input is a *classified* lines table (job_id, line_no, idx, value, label,
category, severity). Evidence arrays hold the first lines up to a cap that the
caller sets (top-k with a partial, map-side group limit) or, with the cap None, every line; stacks
come from at most ``STACK_WINDOW`` lines after the first hit, and the full
evidence list stays a long table (``evidence``).
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.classify import severity_rank
from ..functions.lines import is_stack_line
from ..functions.regex import py_strip

SIGNAL_KEY = ["job_id", "label"]


def hits(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("label").isNotNull())


def evidence(classified: DataFrame) -> DataFrame:
    """Every evidence line as a row: job_id, label, idx, line (stripped) (A5)."""
    return hits(classified).select("job_id", "label", "idx", py_strip(F.col("value")).alias("line"))


def top_evidence(classified: DataFrame, n: int | None = R.EVIDENCE_CAP) -> DataFrame:
    """First ``n`` evidence lines (None: all) per (job, label) as rows with their rank."""
    w = Window.partitionBy(*SIGNAL_KEY).orderBy("idx")
    return (
        hits(classified)
        .select("job_id", "label", "idx", "value")
        .withColumn("rank", F.row_number().over(w).cast("bigint"))
        .filter(F.lit(True) if n is None else F.col("rank") <= n)
        .select("job_id", "label", "rank", "idx", py_strip(F.col("value")).alias("line"))
    )


def _ordered(col_struct_list, field: str):
    return F.transform(F.array_sort(col_struct_list), lambda s: s[field])


def _span(at, window: int):
    """First position of the span of ``window`` positions that ``at`` lies in."""
    return at - at % max(window, 1)


def _probes(firsts: DataFrame, window: int) -> DataFrame:
    """(job_id, label, first_idx, _span): the spans, two at most, that the ``window`` positions after a first hit lie in."""
    first, size = F.col("first_idx"), max(window, 1)
    spans = F.sequence(_span(first + 1, window), _span(first + size, window), F.lit(size).cast("long"))
    return firsts.select("job_id", "label", "first_idx", F.explode(spans).alias("_span"))


def stack_traces(classified: DataFrame, firsts: DataFrame, window: int = R.STACK_WINDOW) -> DataFrame:
    """Stack trace after the first hit of each signal.

    Within the ``window`` non-blank lines after the hit: skip to the first
    stack line, take the contiguous run of stack lines, strip and join them
    with newlines. Positions are cut into spans of ``window``; only the one or two spans that the
    positions after a first hit lie in are probed (an equi-join on (job, span)); no window spans a whole log.
    Signals with no stack line in reach get no row.
    """
    flag = F.col("_stack") if "_stack" in classified.columns else is_stack_line(F.col("value"))
    stack_lines = classified.filter(F.col("idx").isNotNull() & flag).select(
        "job_id", _span(F.col("idx"), window).alias("_span"), "idx", py_strip(F.col("value")).alias("frame"))
    m = _probes(firsts, window).join(stack_lines, ["job_id", "_span"], "inner").where(
        (F.col("idx") > F.col("first_idx")) & (F.col("idx") <= F.col("first_idx") + window))
    # At most `window` matches per signal: collect them in position order and
    # keep the first run of consecutive positions. Positions strictly increase,
    # so idx == first + i holds exactly up to the first gap.
    found = m.groupBy(*SIGNAL_KEY).agg(F.array_sort(F.collect_list(F.struct("idx", "frame"))).alias("_m"))
    first_run = F.filter("_m", lambda x, i: x["idx"] == F.get(F.col("_m"), 0)["idx"] + i)
    return found.select(*SIGNAL_KEY, F.array_join(F.transform(first_run, lambda x: x["frame"]), "\n")
                        .alias("stack_trace"))


def signals(classified: DataFrame, evidence_cap: int | None = R.EVIDENCE_CAP,
            stack_window: int = R.STACK_WINDOW, persist: bool = True) -> DataFrame:
    """One row per (job, label) (A4): category, severity, sev_rank, n (hits),
    first_idx, evidence (first ``evidence_cap`` stripped lines) and the stack
    trace of the first hit (NULL if none). ``evidence_cap=None`` keeps every evidence line.

    Counts, evidence and stacks are three reads of the input; with
    ``persist`` the narrow part they need (labelled and stack lines only) is
    cached once instead of recomputing the input three times.
    """
    cached = []
    if persist:
        flag = F.col("_stack") if "_stack" in classified.columns else is_stack_line(F.col("value"))
        classified = (
            classified.select("job_id", "idx", "value", "label", "category", "severity",
                              (F.col("idx").isNotNull() & flag).alias("_stack"))
            .filter(F.col("label").isNotNull() | F.col("_stack"))
            .persist(StorageLevel.MEMORY_AND_DISK)
        )
        cached = [classified]
    h = hits(classified)
    counts = h.groupBy(*SIGNAL_KEY).agg(
        F.min_by(F.col("category"), F.col("idx")).alias("category"),
        F.min_by(F.col("severity"), F.col("idx")).alias("severity"),
        F.count(F.lit(1)).alias("n"),
        F.min("idx").alias("first_idx"),
    )
    if evidence_cap is None:
        ev = evidence(classified).groupBy(*SIGNAL_KEY).agg(
            _ordered(F.collect_list(F.struct("idx", "line")), "line").alias("evidence"))
    else:
        ev = top_evidence(classified, evidence_cap).groupBy(*SIGNAL_KEY).agg(
            _ordered(F.collect_list(F.struct("rank", "line")), "line").alias("evidence"))
    st = stack_traces(classified, counts.select("job_id", "label", "first_idx"), stack_window)
    out = (
        counts.join(ev, SIGNAL_KEY, "left")
        .join(st, SIGNAL_KEY, "left")
        .select("job_id", "label", "category", "severity",
                severity_rank(F.col("severity")).alias("sev_rank"),
                "n", "first_idx", "evidence", "stack_trace")
    )
    out._logsieve_cached = cached  # see plans.analyze.release
    return out


def rank_signals(sigs: DataFrame) -> DataFrame:
    """Signal rank per job: severity first, then first appearance."""
    w = Window.partitionBy("job_id").orderBy("sev_rank", "first_idx")
    return sigs.withColumn("signal_rank", F.row_number().over(w).cast("bigint"))


def primary_signal(sigs: DataFrame) -> DataFrame:
    """The top-ranked signal per job as a struct (W2); jobs without signals
    have no row here (left-join from the job list to keep them)."""
    fields = ["label", "category", "severity", "n", "first_idx", "evidence", "stack_trace"]
    return sigs.groupBy("job_id").agg(
        F.min_by(F.struct(*fields), F.struct("sev_rank", "first_idx")).alias("primary")
    )


def error_snippet(sigs: DataFrame, n_signals: int = R.SNIPPET_SIGNALS,
                  n_evidence: int = R.SNIPPET_EVIDENCE,
                  stack_chars: int = R.SNIPPET_STACK_CHARS) -> DataFrame:
    """Concise snippet per job (T1): for the top signals, their first evidence
    lines then the stack cut to ``stack_chars``; joined with newlines. Jobs
    without signals have no row."""
    return signal_rollup(sigs, n_signals, n_evidence, stack_chars).select("job_id", "raw_error_snippet")


SIGNAL_FIELDS = ["label", "category", "severity", "n", "first_idx", "evidence", "stack_trace"]


def signal_rollup(sigs: DataFrame, n_signals: int = R.SNIPPET_SIGNALS,
                  n_evidence: int = R.SNIPPET_EVIDENCE,
                  stack_chars: int = R.SNIPPET_STACK_CHARS) -> DataFrame:
    """Everything the analysis needs from the signals of a job, in one
    aggregation: all_signals (rank order: severity, then first hit),
    primary (rank 1, NULL if none) and raw_error_snippet (T1).

    A job has at most one signal per rule, so the collected array is bounded
    by the size of the rule table; the signals are read once.
    """
    ordered = F.array_sort(F.collect_list(F.struct(
        F.col("sev_rank").alias("_rank"), F.col("first_idx").alias("_first"), *SIGNAL_FIELDS)))
    g = sigs.groupBy("job_id").agg(ordered.alias("_s"))
    strip = lambda x: F.struct(*[x[f].alias(f) for f in SIGNAL_FIELDS])
    parts = F.transform(
        F.slice(F.col("_s"), 1, n_signals),
        lambda x: F.concat(
            F.slice(x["evidence"], 1, n_evidence),
            F.when(F.length(x["stack_trace"]) > 0, F.array(F.substring(x["stack_trace"], 1, stack_chars)))
            .otherwise(F.array().cast("array<string>")),
        ),
    )
    return g.select(
        "job_id",
        F.transform("_s", strip).alias("all_signals"),
        strip(F.get(F.col("_s"), 0)).alias("primary"),
        F.array_join(F.flatten(parts), "\n").alias("raw_error_snippet"),
    )
