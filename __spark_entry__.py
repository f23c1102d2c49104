"""

Every query reads the driver's parquet tables (or data Spark derives from
them) in full: the rendered log corpus comes from ``events``, log text from
``documents`` / ``conversations``, failure contexts from ``events`` rows of
type 'error'. Column names match the DuckDB statements in ``oracle_sql``.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The package sits next to this file; make it importable from any working folder.
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from logsieve import rules as R  # noqa: E402
from logsieve.checks import duckdb_sql as D  # noqa: E402
from logsieve.checks.corpus import (  # noqa: E402
    FILLER, FILLER_TIMES, render_blocks, render_corpus, render_failures, render_log_files, render_task_logs, write_text_files)
from logsieve.operators import classify as C  # noqa: E402
from logsieve.operators import context as X  # noqa: E402
from logsieve.operators import signals as S  # noqa: E402
from logsieve.operators import tail as TL  # noqa: E402
from logsieve.operators import report as RP  # noqa: E402
from logsieve.plans.analyze import analyze, flat_analysis  # noqa: E402
from logsieve.plans.triage import triage_report, triage_table  # noqa: E402
from logsieve.sources import airflow as AF  # noqa: E402
from logsieve.sources import files as FS  # noqa: E402
from logsieve.sources.text import lines_from_text  # noqa: E402

AS_OF = "2024-02-01T00:00:00"
# Split date of the watched-files fixture: the manifest holds what was seen before it.
MANIFEST_DATE = "2024-01-15 00:00:00"
LOG_BASE = "/logs"
# Cut of tail_bytes_cut: most documents are longer.
CUT_BYTES = 1001


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return render_corpus(_t(spark, d, "events"))


def _classified(spark, d):
    return C.classify(_lines(spark, d))


# --------------------------------------------------------------------------
# Spark queries
# --------------------------------------------------------------------------

def q_number_lines(spark, d):
    return _lines(spark, d).select("job_id", "line_no", "idx", "value")


def q_parse_lines(spark, d):
    return C.parse_lines(_lines(spark, d)).select(
        "job_id", "line_no", "idx", "ts", "level", "thread", "logger", "message")


def q_level_anywhere(spark, d):
    return C.with_level_anywhere(_lines(spark, d)).select("job_id", "line_no", "level")


def q_classify(spark, d):
    return S.hits(_classified(spark, d)).select("job_id", "line_no", "label", "category", "severity")


def q_classify_join(spark, d):
    return C.classify_join(_lines(spark, d), C.rule_table(spark)).select(
        "job_id", "line_no", "label", "category", "severity")


def q_level_stats(spark, d):
    return X.level_stats(render_blocks(_t(spark, d, "events")))


def q_line_totals(spark, d):
    return X.line_totals(render_blocks(_t(spark, d, "events")))


def q_job_context(spark, d):
    return X.job_context(_lines(spark, d)).withColumn(
        "failed_stages", F.array_join("failed_stages", ","))


def q_failed_stages(spark, d):
    return X.failed_stages(_lines(spark, d)).withColumn(
        "failed_stages", F.array_join("failed_stages", ","))


def q_signals(spark, d):
    return S.signals(_classified(spark, d)).withColumn("evidence", F.array_join("evidence", "\n"))


def q_signals_all_evidence(spark, d):
    return S.signals(_classified(spark, d), evidence_cap=None).withColumn("evidence", F.array_join("evidence", "\n"))


# User rules: one of an unknown severity before the default ones, and one that hits document text.
USER_RULES = [(-2, "task hit a limit|no space left", "Own", "INFO", "own limit"), (-1, "licen[cs]e|copyright", "Own", "LOW", "own license"),
              *R.DEFAULT_RULES]


def q_signals_user_rules(spark, d):
    return S.rank_signals(S.signals(C.classify(_lines(spark, d), USER_RULES), evidence_cap=None)).select(
        "job_id", "label", "severity", "sev_rank", "signal_rank", "n", F.array_join("evidence", "\n").alias("evidence"))


def q_classify_join_user_rules(spark, d):
    lines = lines_from_text(_t(spark, d, "documents"), "doc_id", "text")
    return C.classify_join(lines, C.rule_table(spark, USER_RULES), block=4).select(
        "job_id", "line_no", "label", "category", "severity")


def q_evidence(spark, d):
    return S.evidence(_classified(spark, d))


def q_top_evidence(spark, d):
    return S.top_evidence(_classified(spark, d), R.EVIDENCE_CAP)


def q_stack_traces(spark, d):
    from pyspark import StorageLevel
    cl = _classified(spark, d).persist(StorageLevel.MEMORY_AND_DISK)
    firsts = S.hits(cl).groupBy("job_id", "label").agg(F.min("idx").alias("first_idx"))
    return S.stack_traces(cl, firsts)


def q_rank_signals(spark, d):
    return S.rank_signals(S.signals(_classified(spark, d))).select(
        "job_id", "label", "signal_rank", "severity", "first_idx")


def q_primary_signal(spark, d):
    p = S.primary_signal(S.signals(_classified(spark, d)))
    return p.select("job_id", *[F.col(f"primary.{c}").alias(c) for c in
                                ("label", "category", "severity", "n", "first_idx")])


def q_error_subset(spark, d):
    lv = C.classify(C.with_level_anywhere(_lines(spark, d)))
    return TL.error_subset(lv).select("job_id", "line_no", "level", "label", "value")


def q_log_tail(spark, d):
    return TL.log_tail(_lines(spark, d))


def q_error_snippet(spark, d):
    return S.error_snippet(S.signals(_classified(spark, d)))


def q_analyze(spark, d):
    return flat_analysis(analyze(_lines(spark, d), as_of=AS_OF, evidence_cap=R.EVIDENCE_CAP))


def _analysis(spark, d, evidence_cap=R.EVIDENCE_CAP):
    return analyze(_lines(spark, d), as_of=AS_OF, evidence_cap=evidence_cap)


def _flat_triage(df):
    def lst(c):
        return F.array_join(c, "|")

    def mp(c):
        return F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return df.select(
        "job_id", "category", "confidence", "severity", "failure_signature", "root_cause",
        lst(F.col("immediate_mitigation")).alias("immediate_mitigation"),
        lst(F.col("permanent_fix")).alias("permanent_fix"),
        lst(F.col("verify_steps")).alias("verify_steps"),
        mp(F.col("spark_config_recommendations")).alias("spark_config_recommendations"),
        mp(F.col("incident_notes")).alias("incident_notes"),
        "model_used", "tokens_used", "timestamp",
    )


def q_rule_triage(spark, d):
    return _flat_triage(RP.rule_triage(_analysis(spark, d)))


def q_alert_gate(spark, d):
    return RP.alert_gate(RP.rule_triage(_analysis(spark, d))).select("job_id", "severity")


def q_alert_text(spark, d):
    return RP.alert_text(triage_table(_analysis(spark, d)))


def q_alert_outbox(spark, d):
    alerts = RP.alert_text(RP.alert_gate(triage_table(_analysis(spark, d))))
    return RP.alert_outbox(alerts).select("job_id", "recipient", "subject")


def q_triage_report(spark, d):
    return triage_report(_lines(spark, d), as_of=AS_OF)


def q_build_prompt(spark, d):
    return RP.build_prompt(_analysis(spark, d))


def _replies(spark, d):
    """Model replies derived from the rule triage of each job: plain JSON,
    fenced JSON, JSON inside prose, a JSON list, keys missing or null, prose."""
    tri = RP.rule_triage(_analysis(spark, d))
    js = F.to_json(F.struct(*[c for c in RP.TRIAGE_COLUMNS if c not in ("job_id", "model_used", "tokens_used", "timestamp")]))
    k = F.regexp_extract("job_id", r"(\d+)$", 1).cast("bigint") % 7
    raw = (
        F.when(k == 0, js)
        .when(k == 1, F.concat(F.lit("```json\n"), js, F.lit("\n```")))
        .when(k == 2, F.concat(F.lit("Here is the triage: "), js, F.lit(" Thanks.")))
        .when(k == 3, F.concat(F.lit("["), js, F.lit("]")))
        .when(k == 4, F.lit('{"category": "Infra", "severity": null, "permanent_fix": ["a", "b"]}'))
        .when(k == 5, F.concat(F.lit("No JSON here, only prose about "), F.col("failure_signature")))
        .otherwise(F.lit(""))
    )
    return tri.select("job_id", raw.alias("raw"), F.lit("replay").alias("model"),
                      (F.length(js) / 4).cast("bigint").alias("tokens"))


def q_parse_response(spark, d):
    return _flat_triage(RP.parse_response(_replies(spark, d), as_of=AS_OF))


def q_triage_defaults(spark, d):
    p = RP.parse_response(_replies(spark, d), as_of=AS_OF)
    return p.select("job_id", "parsed", "category", "confidence", "severity", "failure_signature",
                    F.size("permanent_fix").cast("bigint").alias("n_fix"),
                    F.size("incident_notes").cast("bigint").alias("n_notes"))


def q_analysis_json(spark, d):
    return RP.analysis_json(_analysis(spark, d, None))


def q_analysis_pieces(spark, d):
    """The analysis records with every evidence line, in pieces."""
    lines = _lines(spark, d)
    return RP.analysis_pieces(analyze(lines, as_of=AS_OF, evidence_cap=R.EVIDENCE_CAP), S.evidence(C.classify(lines)))


def q_triage_json(spark, d):
    a = _analysis(spark, d)
    return RP.triage_json(RP.rule_triage(a), a)


def q_lines_from_text(spark, d):
    return lines_from_text(_t(spark, d, "documents"), "doc_id", "text").select(
        "job_id", "line_no", "idx", "value")


def q_skip_tiny(spark, d):
    docs = _t(spark, d, "documents")
    return FS.skip_tiny(docs, "text").select(
        F.col("doc_id").cast("string").alias("job_id"), FS.stripped_length(F.col("text")).alias("n_chars"))


def q_tail_bytes(spark, d):
    docs = _t(spark, d, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("job_id"),
                       FS.tail_bytes(F.col("text")).alias("tail"))


def q_tail_bytes_cut(spark, d):
    docs = _t(spark, d, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("job_id"),
                       FS.tail_bytes(F.col("text"), CUT_BYTES).alias("tail"))


def q_job_from_task_path(spark, d):
    files = render_log_files(_contexts(spark, d), LOG_BASE)
    return FS.job_from_path(files.select("path"), "path").select(
        "path", "job_id", "dag_id", "task_id", "execution_date", "try_number", "airflow_job")


def q_job_from_path(spark, d):
    pages = _t(spark, d, "pages")
    return FS.job_from_path(pages.select("page_id", F.col("url").alias("path")), "path").select(
        "page_id", "job_id", "dag_id", "task_id", "execution_date", "try_number")


def _listing(events, before=None):
    e = events if before is None else events.filter(F.col("ts") < F.lit(before).cast("timestamp_ntz"))
    return e.groupBy(F.concat(F.lit("job_"), F.col("user_id").cast("string")).alias("path")).agg(
        F.max("ts").alias("mtime"))


def q_changed_files(spark, d):
    ev = _t(spark, d, "events")
    changed, _ = FS.changed_files(_listing(ev), _listing(ev, MANIFEST_DATE))
    return changed


def q_manifest(spark, d):
    ev = _t(spark, d, "events")
    _, manifest = FS.changed_files(_listing(ev), _listing(ev, MANIFEST_DATE))
    return manifest


def _contexts(spark, d):
    return AF.failure_context(render_failures(_t(spark, d, "events")), AS_OF, keep=["failure_id"])


def q_failure_context(spark, d):
    return _contexts(spark, d)


def _located(spark, d):
    ctx = _contexts(spark, d)
    files = render_log_files(ctx, LOG_BASE)
    return AF.locate_logs(ctx, files, LOG_BASE), files


def q_locate_logs(spark, d):
    located, _ = _located(spark, d)
    return located.select("failure_id", "log_path")


def q_resolve_log_text(spark, d):
    located, files = _located(spark, d)
    return AF.resolve_log_text(located, files).select("failure_id", "log_text")


def q_enrich_notes(spark, d):
    from logsieve.plans.failures import triage_failures
    return _flat_triage(triage_failures(*_failure_inputs(spark, d)).drop("job_name", "alert"))


def _failure_inputs(spark, d):
    failures = render_failures(_t(spark, d, "events"))
    ctx = AF.failure_context(failures, AS_OF, keep=["failure_id"])
    files = render_log_files(ctx, LOG_BASE)
    return failures, files, LOG_BASE, AS_OF


def q_triage_failures(spark, d):
    from logsieve.plans.failures import triage_failures
    t = triage_failures(*_failure_inputs(spark, d))
    return t.filter("alert").select("job_id", "job_name", "category", "severity", "failure_signature")


def q_triage_failures_in_folder(spark, d):
    """The failures of the task logs in a folder: the last CUT_BYTES bytes of each log are read, half of them with CRLF."""
    from logsieve.plans.failures import triage_failures_in_folder
    base = _local(_scratch(spark, "airflow_logs"))
    write_text_files(render_task_logs(_contexts(spark, d), base))
    failures = render_failures(_t(spark, d, "events"))
    t = triage_failures_in_folder(spark, failures, base, AS_OF, max_bytes=CUT_BYTES)
    return t.select("job_id", "job_name", "category", "severity", "failure_signature", "alert")


def q_tail_files(spark, d):
    """The last CUT_BYTES bytes of every document, written as a file of its own."""
    base = _local(_scratch(spark, "documents"))
    name = F.concat(F.lit(base + "/"), F.col("doc_id").cast("string"), F.lit(".log"))
    files = _t(spark, d, "documents").select(name.alias("path"), "text")
    write_text_files(files)
    return FS.tail_files(files, CUT_BYTES).select(FS.file_stem(F.col("path")).alias("job_id"), F.col("text").alias("tail"))


def _local(path):
    return FS.plain_name(path)


def _scratch(spark, name):
    import uuid

    from logsieve.session import scratch_path
    return scratch_path(spark, f"{name}/{uuid.uuid4().hex}")


def _corpus_files(spark, d):
    """The rendered corpus written as log files (one folder per job) in the
    session's shared checkpoint folder; returns the folder."""
    base = _scratch(spark, "corpus_logs")
    FS.write_log_files(_lines(spark, d), base)
    return base


def q_read_logs(spark, d):
    return FS.read_logs(spark, _corpus_files(spark, d), glob="*.txt", job="dir").select(
        "job_id", "line_no", "idx", "value")


def q_read_logs_cut(spark, d):
    """The same from ranges of 1000 bytes: most jobs are read by many tasks."""
    return FS.read_logs(spark, _corpus_files(spark, d), glob="*.txt", job="dir", range_bytes=1000, task_bytes=50_000).select(
        "job_id", "line_no", "idx", "value")


def q_analyze_files(spark, d):
    """Every file is a log of its own: the corpus as one file per job, in folders with blanks and
    brackets in their names; one task writes several jobs, so file names repeat across folders."""
    base, keys = _scratch(spark, "task_logs"), ["dag", "job_id"]
    lines = _lines(spark, d).withColumn("dag", F.concat(F.lit("dag [x] "), F.length("job_id").cast("string")))
    FS.write_folders(lines.repartition("job_id").sortWithinPartitions(*keys, "line_no"), base, keys)
    a = flat_analysis(analyze(FS.read_logs(spark, base, glob="*.txt"), as_of=AS_OF, evidence_cap=R.EVIDENCE_CAP))
    return a.withColumn("job_id", F.regexp_extract("job_id", "/dag=dag [^/]*/job_id=([^/]+)/[^/]+$", 1))


def q_watch_logs(spark, d):
    from logsieve.streaming.watch import read_outbox, watch_logs
    src, out = _corpus_files(spark, d), _scratch(spark, "watch_out")
    q = watch_logs(spark, src, out, glob="*.txt", available_now=True, as_of=AS_OF, job="dir")
    q.awaitTermination()
    return read_outbox(spark, out)


def q_rescan_logs(spark, d):
    """First scan of the corpus log files against an empty manifest: every
    file is new, so every line comes back (later scans return changes only)."""
    from logsieve.streaming.rescan import rescan
    scan = rescan(spark, _corpus_files(spark, d), _scratch(spark, "manifest"), glob="*.txt", job="dir")
    return scan.lines.select("job_id", "line_no", "idx", "value")


def _growing(spark, d, base):
    """The corpus in two steps below ``base``: the events before MANIFEST_DATE, then the others as further files of the same jobs."""
    events = _t(spark, d, "events")
    before = F.col("ts") < F.expr(f"TIMESTAMP_NTZ'{MANIFEST_DATE}'")
    for part, some in enumerate((before, ~before)):
        FS.write_log_files(render_corpus(events.where(some)), f"{base}/part={part}")
        yield part


def q_rescan_alerts(spark, d):
    """Two scheduled runs over a folder that grows: the first triages all there is, the second the jobs that
    have grown since, whole. The alerts of both are returned."""
    from logsieve.streaming.rescan import rescan_to_outbox
    base, manifest, out = (_scratch(spark, x) for x in ("grown_logs", "manifest", "rescan_out"))
    for _ in _growing(spark, d, base):
        rescan_to_outbox(spark, base, manifest, out, glob="*.txt", job="dir", as_of=AS_OF)
    return spark.read.parquet(out).select(F.col("scan").cast("int").alias("scan"), "job_id", "recipient", "severity", "subject", "body")


def q_watch_changes(spark, d):
    """The watch over the same growing folder, stopped and started in between: jobs that have grown are triaged again."""
    from logsieve.streaming.watch import read_outbox, watch_logs
    base, out = (_scratch(spark, x) for x in ("watched_logs", "watch_out"))
    for _ in _growing(spark, d, base):
        watch_logs(spark, base, out, glob="*.txt", available_now=True, as_of=AS_OF, job="dir").awaitTermination()
    return read_outbox(spark, out)


def q_tail_bytes_lines(spark, d):
    return FS.tail_bytes_lines(_lines(spark, d))


def q_tail_bytes_lines_cut(spark, d):
    return FS.tail_bytes_lines(lines_from_text(_t(spark, d, "documents"), "doc_id", "text"), CUT_BYTES, chunk_lines=3)


def q_analyze_error_subset(spark, d):
    return flat_analysis(analyze(_lines(spark, d), as_of=AS_OF, scope="error_subset"))


def q_classify_documents(spark, d):
    lines = lines_from_text(_t(spark, d, "documents"), "doc_id", "text")
    return S.hits(C.classify(lines)).select("job_id", "line_no", "label", "category", "severity")


def _turns(spark, d):
    conv = _t(spark, d, "conversations")
    return conv.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("job_id"),
                       "text")


def q_analyze_conversations(spark, d):
    return flat_analysis(analyze(lines_from_text(_turns(spark, d), "job_id", "text"), as_of=AS_OF))


def q_stream_signal_counts(spark, d):
    from logsieve.streaming import watch as WT
    src, out = _corpus_files(spark, d), _scratch(spark, "signal_counts")
    stream = WT.stream_logs(spark, src, glob="*.txt", state=f"{out}/_checkpoint/files")
    stream = stream.withColumn("job_id", FS.job_column(F.col("path") if FS.BR.can_open(src) else FS.file_path(F.col("path")), "dir"))
    WT.write_signal_counts(stream.select("job_id", "value"), out, available_now=True).awaitTermination()
    return WT.latest_signal_counts(spark, out)


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "number_lines": q_number_lines,
    "parse_lines": q_parse_lines,
    "level_anywhere": q_level_anywhere,
    "classify": q_classify,
    "classify_join": q_classify_join,
    "level_stats": q_level_stats,
    "line_totals": q_line_totals,
    "job_context": q_job_context,
    "failed_stages": q_failed_stages,
    "signals": q_signals,
    "evidence": q_evidence,
    "top_evidence": q_top_evidence,
    "stack_traces": q_stack_traces,
    "rank_signals": q_rank_signals,
    "primary_signal": q_primary_signal,
    "error_subset": q_error_subset,
    "log_tail": q_log_tail,
    "error_snippet": q_error_snippet,
    "analyze": q_analyze,
    "rule_triage": q_rule_triage,
    "alert_gate": q_alert_gate,
    "alert_text": q_alert_text,
    "alert_outbox": q_alert_outbox,
    "triage_report": q_triage_report,
    "build_prompt": q_build_prompt,
    "parse_response": q_parse_response,
    "triage_defaults": q_triage_defaults,
    "analysis_json": q_analysis_json,
    "analysis_pieces": q_analysis_pieces,
    "triage_json": q_triage_json,
    "lines_from_text": q_lines_from_text,
    "skip_tiny": q_skip_tiny,
    "tail_bytes": q_tail_bytes,
    "job_from_path": q_job_from_path,
    "changed_files": q_changed_files,
    "manifest": q_manifest,
    "failure_context": q_failure_context,
    "locate_logs": q_locate_logs,
    "resolve_log_text": q_resolve_log_text,
    "enrich_notes": q_enrich_notes,
    "triage_failures": q_triage_failures,
    "read_logs": q_read_logs,
    "read_logs_cut": q_read_logs_cut,
    "triage_failures_in_folder": q_triage_failures_in_folder,
    "tail_files": q_tail_files,
    "watch_changes": q_watch_changes,
    "watch_logs": q_watch_logs,
    "analyze_error_subset": q_analyze_error_subset,
    "classify_documents": q_classify_documents,
    "analyze_conversations": q_analyze_conversations,
    "stream_signal_counts": q_stream_signal_counts,
    "tail_bytes_lines": q_tail_bytes_lines,
    "rescan_logs": q_rescan_logs,
    "rescan_alerts": q_rescan_alerts,
    "analyze_files": q_analyze_files,
    "signals_user_rules": q_signals_user_rules,
    "signals_all_evidence": q_signals_all_evidence,
    "classify_join_user_rules": q_classify_join_user_rules,
    "tail_bytes_cut": q_tail_bytes_cut,
    "tail_bytes_lines_cut": q_tail_bytes_lines_cut,
    "job_from_task_path": q_job_from_task_path,
}


# --------------------------------------------------------------------------
# DuckDB statements
# --------------------------------------------------------------------------

def _level_anywhere_sql(c="value"):
    return f"coalesce(nullif(regexp_extract({c}, {D.q(R.LEVEL_ANYWHERE_PATTERN)}, 1), ''), 'INFO')"


_SIGNAL_HEAD = """'{"category":"' || p.category || '","pattern_matched":"' || p.label || '","severity":"' || p.severity || '","evidence_lines":['"""
_SIGNAL_END = """'],"stack_trace":' || coalesce(CAST(to_json(p.stack_trace) AS VARCHAR), 'null') || '}'"""


def _oracles() -> dict[str, str]:
    lp = R.LOG_LINE_PATTERN
    W = D.with_corpus
    return {
        "number_lines": W("SELECT job_id, line_no, idx, value FROM lines"),
        "parse_lines": W(f"""
SELECT job_id, line_no, idx,
       nullif(regexp_extract(value, {D.q(lp)}, 1), '') AS ts,
       coalesce(nullif(regexp_extract(value, {D.q(lp)}, 2), ''), 'INFO') AS level,
       nullif(regexp_extract(value, {D.q(lp)}, 3), '') AS thread,
       regexp_extract(value, {D.q(lp)}, 4) AS logger,
       coalesce(nullif(regexp_extract(value, {D.q(lp)}, 5), ''), value) AS message
FROM lines WHERE idx IS NOT NULL"""),
        "level_anywhere": W(f"SELECT job_id, line_no, {_level_anywhere_sql()} AS level FROM lines"),
        "classify": W("SELECT job_id, line_no, label, category, severity FROM hits"),
        "classify_join": W("SELECT job_id, line_no, label, category, severity FROM hits"),
        "level_stats": W(f"SELECT job_id, {_level_anywhere_sql()} AS level, count(*) AS n_lines "
                         "FROM lines GROUP BY ALL"),
        "line_totals": W("SELECT job_id, count(*) AS total_lines, count(idx) AS nonblank_lines "
                         "FROM lines GROUP BY job_id"),
        "job_context": W("SELECT job_id, platform, spark_version, total_log_lines, error_count, warn_count, "
                         "failed_stages, executors_lost, oom_events, shuffle_failures, task_retries FROM ctx"),
        "failed_stages": W("SELECT job_id, failed_stages FROM stages"),
        "signals": W("SELECT job_id, label, category, severity, sev_rank, n, first_idx, evidence, stack_trace "
                     "FROM signals"),
        "signals_all_evidence": W("SELECT job_id, label, category, severity, sev_rank, n, first_idx, "
                                  "array_to_string(evidence_list, chr(10)) AS evidence, stack_trace FROM signals"),
        "signals_user_rules": W("SELECT job_id, label, severity, sev_rank, signal_rank, n, "
                                "array_to_string(evidence_list, chr(10)) AS evidence FROM ranked", rules=USER_RULES),
        "classify_join_user_rules": "WITH " + D.text_lines_sql("documents", "doc_id", "text")
                                    + ",\nlines AS (SELECT job_id, line_no, idx, value FROM text_lines),"
                                    + D.analysis_ctes(USER_RULES)
                                    + "\nSELECT job_id, line_no, label, category, severity FROM hits",
        "rescan_alerts": _grown_sql("scan, "),
        "watch_changes": _grown_sql(""),
        "analyze_files": W(_FLAT_ANALYSIS_SELECT),
        "tail_bytes_cut": _cut_sql("SELECT CAST(doc_id AS VARCHAR) AS job_id, text FROM documents", "tail"),
        "tail_bytes_lines_cut": _cut_sql("WITH " + D.text_lines_sql("documents", "doc_id", "text")
                                         + "\nSELECT job_id, string_agg(value, chr(10) ORDER BY line_no) || chr(10) AS text "
                                           "FROM text_lines GROUP BY job_id", "text"),
        "job_from_task_path": "WITH " + _failure_ctes() + """
SELECT path, parts[-1][:-5] AS job_id, parts[-4] AS dag_id, parts[-3] AS task_id, parts[-2] AS execution_date,
       parts[-1][:-5] AS try_number, parts[-4] || '.' || parts[-3] AS airflow_job
FROM (SELECT path, string_split(path, '/') AS parts FROM ffiles)""",
        "evidence": W(f"SELECT job_id, label, idx, {D.strip('value')} AS line FROM hits"),
        "top_evidence": W(f"SELECT job_id, label, rank, idx, line FROM ev_ranked WHERE rank <= {R.EVIDENCE_CAP}"),
        "stack_traces": W("SELECT job_id, label, stack_trace FROM stacks"),
        "rank_signals": W("SELECT job_id, label, signal_rank, severity, first_idx FROM ranked"),
        "primary_signal": W("SELECT job_id, label, category, severity, n, first_idx FROM primary_sig"),
        "error_subset": W(f"""
SELECT job_id, line_no, level, label, value FROM (
  SELECT job_id, line_no, level, label, value,
         row_number() OVER (PARTITION BY job_id ORDER BY line_no) AS r
  FROM (SELECT *, {_level_anywhere_sql()} AS level FROM labelled)
  WHERE level IN ('ERROR', 'FATAL') OR label IS NOT NULL)
WHERE r <= {R.ERROR_SUBSET_LINES}"""),
        "log_tail": W("SELECT job_id, log_tail FROM tail"),
        "error_snippet": W("SELECT job_id, raw_error_snippet FROM snippet"),
        "analyze": W("SELECT job_id, platform, spark_version, total_log_lines, error_count, warn_count, "
                     "executors_lost, oom_events, shuffle_failures, task_retries, failed_stages, "
                     "primary_label, primary_category, primary_severity, n_signals, signal_list, "
                     "raw_error_snippet, log_tail FROM analysis"),
        "rule_triage": W("SELECT * EXCLUDE (platform, spark_version) FROM triage", _triage_sql_ctes()),
        "alert_gate": W("SELECT job_id, severity FROM gated", _triage_sql_ctes()),
        "alert_text": W("SELECT job_id, severity, subject, body FROM alert_texts", _triage_sql_ctes()),
        "alert_outbox": W("SELECT job_id, recipient, subject FROM outbox", _triage_sql_ctes()),
        "triage_report": W("SELECT job_id, recipient, severity, subject, body FROM outbox", _triage_sql_ctes()),
        "watch_logs": W("SELECT job_id, recipient, severity, subject, body FROM outbox", _triage_sql_ctes()),
        "read_logs": W("SELECT job_id, line_no, idx, value FROM lines"),
        "read_logs_cut": W("SELECT job_id, line_no, idx, value FROM lines"),
        "tail_files": _cut_sql("SELECT CAST(doc_id AS VARCHAR) AS job_id, text FROM documents", "tail"),
        "rescan_logs": W("SELECT job_id, line_no, idx, value FROM lines"),
        "stream_signal_counts": W("SELECT job_id, label, count(*) AS n, any_value(severity) AS severity "
                                  "FROM hits GROUP BY job_id, label"),
        "analyze_error_subset": _error_subset_sql(),
        "analysis_json": W(f"""
SELECT job_id, to_json({{
  'job_context': {{'job_name': job_id, 'platform': platform, 'spark_version': spark_version,
                  'total_log_lines': total_log_lines, 'error_count': error_count, 'warn_count': warn_count,
                  'failed_stages': stage_list, 'executors_lost': executors_lost, 'oom_events': oom_events,
                  'shuffle_failures': shuffle_failures, 'task_retries': task_retries,
                  'duration_seconds': CAST(NULL AS DOUBLE), 'start_time': CAST(NULL AS VARCHAR),
                  'end_time': CAST(NULL AS VARCHAR)}},
  'primary_signal': primary_dict,
  'all_signals': coalesce(signal_dicts, []),
  'raw_error_snippet': raw_error_snippet,
  'timestamp': {D.q(AS_OF)}}})::VARCHAR AS json
FROM analysis"""),
        "analysis_pieces": W(f"""
SELECT job_id, 0 AS section, 0 AS rank, CAST(0 AS BIGINT) AS idx, '{{"job_context":' || CAST(to_json({{
  'job_name': job_id, 'platform': platform, 'spark_version': spark_version, 'total_log_lines': total_log_lines, 'error_count': error_count,
  'warn_count': warn_count, 'failed_stages': stage_list, 'executors_lost': executors_lost, 'oom_events': oom_events,
  'shuffle_failures': shuffle_failures, 'task_retries': task_retries, 'duration_seconds': CAST(NULL AS DOUBLE),
  'start_time': CAST(NULL AS VARCHAR), 'end_time': CAST(NULL AS VARCHAR)}}) AS VARCHAR) || ',"primary_signal":'
  || CASE WHEN p.label IS NULL THEN 'null' ELSE {_SIGNAL_HEAD} END AS piece
FROM analysis LEFT JOIN (SELECT * FROM ranked WHERE signal_rank = 1) p USING (job_id)
UNION ALL SELECT job_id, section, CAST(signal_rank - 1 AS INTEGER), h.idx,
  CASE WHEN h.idx > first_idx THEN ',' ELSE '' END || CAST(to_json({D.strip('value')}) AS VARCHAR)
FROM hits h JOIN ranked USING (job_id, label), (SELECT unnest([1, 3]) AS section) WHERE section = 3 OR signal_rank = 1
UNION ALL SELECT job_id, 2, 0, 0, CASE WHEN p.label IS NULL THEN '' ELSE {_SIGNAL_END} END || ',"all_signals":['
FROM analysis LEFT JOIN (SELECT * FROM ranked WHERE signal_rank = 1) p USING (job_id)
UNION ALL SELECT job_id, 3, CAST(signal_rank - 1 AS INTEGER), 0, CASE WHEN signal_rank > 1 THEN ',' ELSE '' END || {_SIGNAL_HEAD} FROM ranked p
UNION ALL SELECT job_id, 3, CAST(signal_rank - 1 AS INTEGER), 9223372036854775807, {_SIGNAL_END} FROM ranked p
UNION ALL SELECT job_id, 4, 0, 0, '],"raw_error_snippet":' || CAST(to_json(raw_error_snippet) AS VARCHAR) || ',"timestamp":"{AS_OF}"}}'
FROM analysis"""),
        "triage_json": W(f"""
SELECT t.job_id, to_json({{
  'category': t.category, 'confidence': t.confidence, 'severity': t.severity,
  'failure_signature': t.failure_signature, 'root_cause': t.root_cause,
  'immediate_mitigation': {_sql_list(R.RULE_TRIAGE_MITIGATION)}, 'permanent_fix': {_sql_list(R.RULE_TRIAGE_FIX)},
  'verify_steps': {_sql_list(R.RULE_TRIAGE_VERIFY)},
  'spark_config_recommendations': {_sql_map(R.RULE_TRIAGE_CONFIG)},
  'incident_notes': {_sql_map(R.RULE_TRIAGE_NOTES)},
  'model_used': t.model_used, 'tokens_used': t.tokens_used, 'timestamp': t.timestamp,
  'job_context': {{'job_name': a.job_id, 'platform': a.platform, 'spark_version': a.spark_version,
                  'total_log_lines': a.total_log_lines, 'error_count': a.error_count, 'warn_count': a.warn_count,
                  'failed_stages': a.stage_list, 'executors_lost': a.executors_lost, 'oom_events': a.oom_events,
                  'shuffle_failures': a.shuffle_failures, 'task_retries': a.task_retries,
                  'duration_seconds': CAST(NULL AS DOUBLE), 'start_time': CAST(NULL AS VARCHAR),
                  'end_time': CAST(NULL AS VARCHAR)}}}})::VARCHAR AS json
FROM triage t JOIN analysis a USING (job_id)""", _triage_sql_ctes()),
        "parse_response": _replies_sql(
            "SELECT job_id, category, confidence, severity, failure_signature, root_cause, immediate_mitigation, "
            "permanent_fix, verify_steps, spark_config_recommendations, incident_notes, model_used, tokens_used, "
            "timestamp FROM reply_triage"),
        "triage_defaults": _replies_sql(
            "SELECT job_id, parsed, category, confidence, severity, failure_signature, "
            "CASE WHEN parsed THEN n_fix_obj ELSE 1 END AS n_fix, "
            "CASE WHEN NOT parsed THEN 3 WHEN incident_notes = '' THEN 0 "
            "ELSE len(string_split(incident_notes, '|')) END AS n_notes FROM reply_triage"),
        "tail_bytes_lines": W(f"""
SELECT job_id, CASE WHEN sum(octet_length(encode(value)) + 1) <= {R.TAIL_BYTES}
                    THEN string_agg(value, chr(10) ORDER BY line_no) || chr(10) END AS text
FROM lines GROUP BY job_id"""),
        "classify_documents": "WITH " + D.text_lines_sql("documents", "doc_id", "text")
                              + ",\nlines AS (SELECT job_id, line_no, idx, value FROM text_lines),"
                              + D.analysis_ctes()
                              + "\nSELECT job_id, line_no, label, category, severity FROM hits",
        "analyze_conversations": "WITH turns AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)"
                                 " AS job_id, text FROM conversations),"
                                 + D.text_lines_sql("turns", "job_id", "text")
                                 + ",\nlines AS (SELECT job_id, line_no, idx, value FROM text_lines),"
                                 + D.analysis_ctes() + "\n" + _FLAT_ANALYSIS_SELECT,
        "build_prompt": W(_prompt_sql()),
        "lines_from_text": "WITH " + D.text_lines_sql("documents", "doc_id", "text")
                           + "\nSELECT job_id, line_no, idx, value FROM text_lines",
        "skip_tiny": f"""
SELECT CAST(doc_id AS VARCHAR) AS job_id, length({D.strip('text')}) AS n_chars
FROM documents WHERE length({D.strip('text')}) >= {R.MIN_LOG_CHARS}""",
        "tail_bytes": f"""
SELECT CAST(doc_id AS VARCHAR) AS job_id,
       CASE WHEN octet_length(encode(text)) <= {R.TAIL_BYTES} THEN text END AS tail
FROM documents""",
        "job_from_path": r"""
SELECT page_id,
       CASE WHEN regexp_extract(name, '^(.+)\.[^.]+$', 1) = '' THEN name
            ELSE regexp_extract(name, '^(.+)\.[^.]+$', 1) END AS job_id,
       nullif(regexp_extract(url, '/([^/]+)/([^/]+)/([^/]+)/([^/]+)\.log$', 1), '') AS dag_id,
       nullif(regexp_extract(url, '/([^/]+)/([^/]+)/([^/]+)/([^/]+)\.log$', 2), '') AS task_id,
       nullif(regexp_extract(url, '/([^/]+)/([^/]+)/([^/]+)/([^/]+)\.log$', 3), '') AS execution_date,
       nullif(regexp_extract(url, '/([^/]+)/([^/]+)/([^/]+)/([^/]+)\.log$', 4), '') AS try_number
FROM (SELECT page_id, url, regexp_extract(url, '([^/]*)$', 1) AS name FROM pages)""",
        "changed_files": f"""
WITH l AS (SELECT 'job_' || CAST(user_id AS VARCHAR) AS path, max(ts) AS mtime FROM events GROUP BY 1),
m AS (SELECT 'job_' || CAST(user_id AS VARCHAR) AS path, max(ts) AS mtime FROM events
      WHERE ts < TIMESTAMP {D.q(MANIFEST_DATE)} GROUP BY 1)
SELECT l.path, l.mtime FROM l LEFT JOIN m USING (path) WHERE m.mtime IS NULL OR m.mtime < l.mtime""",
        "manifest": f"""
WITH l AS (SELECT 'job_' || CAST(user_id AS VARCHAR) AS path, max(ts) AS mtime FROM events GROUP BY 1),
m AS (SELECT 'job_' || CAST(user_id AS VARCHAR) AS path, max(ts) AS mtime FROM events
      WHERE ts < TIMESTAMP {D.q(MANIFEST_DATE)} GROUP BY 1)
SELECT path, max(mtime) AS mtime FROM (SELECT * FROM l UNION ALL SELECT * FROM m) GROUP BY path""",
        "failure_context": "WITH " + _failure_ctes() + """
SELECT failure_id, dag_id, task_id, run_id, execution_date, try_number, operator, hostname, log_url,
       exception FROM fctx""",
        "locate_logs": "WITH " + _failure_ctes() + "\nSELECT failure_id, log_path FROM flocated",
        "triage_failures": _failure_triage_sql("""
SELECT t.job_id, r.dag_id || '.' || r.task_id AS job_name, t.category, t.severity, t.failure_signature
FROM triage t JOIN resolved r ON r.failure_id = t.job_id
WHERE t.severity IN ('HIGH', 'CRITICAL')"""),
        "triage_failures_in_folder": _failure_triage_sql("""
SELECT t.job_id, r.dag_id || '.' || r.task_id AS job_name, t.category, t.severity, t.failure_signature,
       t.severity IN ('HIGH', 'CRITICAL') AS alert
FROM triage t JOIN resolved r ON r.failure_id = t.job_id""", folder=True),
        "enrich_notes": _failure_triage_sql("""
SELECT t.job_id, t.category, t.confidence, t.severity, t.failure_signature, t.root_cause,
       t.immediate_mitigation, t.permanent_fix, t.verify_steps, t.spark_config_recommendations,
       t.incident_notes || '|dag_id=' || r.dag_id || '|task_id=' || r.task_id || '|run_id=' || r.run_id
         || '|execution_date=' || r.execution_date || '|try_number=' || CAST(r.try_number AS VARCHAR)
         || '|operator=' || r.operator || '|airflow_log_url=' || r.log_url AS incident_notes,
       t.model_used, t.tokens_used, t.timestamp
FROM triage t JOIN resolved r ON r.failure_id = t.job_id"""),
        "resolve_log_text": "WITH " + _failure_ctes() + f"""
SELECT l.failure_id,
       coalesce(nullif(f.text, ''),
                CASE WHEN l.exception <> '' THEN 'Airflow task failure — no log file found.' || chr(10)
                     || 'DAG: ' || l.dag_id || ' | Task: ' || l.task_id || ' | Run: ' || l.run_id || chr(10)
                     || 'Exception:' || chr(10) || l.exception END,
                'Airflow task ' || l.dag_id || '.' || l.task_id || ' failed. No log available.') AS log_text
FROM flocated l LEFT JOIN ffiles f ON f.path = l.log_path""",
    }


def _grown_sql(scan: str) -> str:
    """The alerts over the events before MANIFEST_DATE, and then those of the jobs with later events, over all events."""
    date = f"TIMESTAMP {D.q(MANIFEST_DATE)}"
    later = f"(SELECT 'job_' || CAST(user_id AS VARCHAR) FROM events WHERE ts >= {date})"
    cols = "job_id, recipient, severity, subject, body"
    first = D.with_corpus(f"SELECT {cols} FROM outbox", _triage_sql_ctes()).replace("FROM events)", f"FROM events WHERE ts < {date})", 1)
    second = D.with_corpus(f"SELECT {cols} FROM outbox WHERE job_id IN {later}", _triage_sql_ctes())
    return f"SELECT {scan}{cols} FROM (SELECT 0 AS scan, * FROM ({first}) UNION ALL SELECT 1 AS scan, * FROM ({second}))"


def _cut_sql(source: str, name: str) -> str:
    """The last CUT_BYTES bytes of each (job_id, text): the characters that fit, after a replacement
    character for each byte of the one that is cut."""
    return f"""
WITH src AS ({source}),
s AS (SELECT job_id, right(text, {CUT_BYTES}) AS r FROM src WHERE octet_length(encode(text)) > {CUT_BYTES}),
c AS (SELECT job_id, unnest(range(1, length(r) + 1)) AS i, unnest(string_split(r, '')) AS ch FROM s),
b AS (SELECT job_id, i, ch, sum(octet_length(encode(ch))) OVER (PARTITION BY job_id ORDER BY i DESC) AS after FROM c),
t AS (SELECT job_id, string_agg(ch, '' ORDER BY i) AS tail, max(after) AS n FROM b WHERE after <= {CUT_BYTES} GROUP BY job_id)
SELECT job_id, repeat(chr(65533), CAST({CUT_BYTES} - n AS INTEGER)) || tail AS {name} FROM t
UNION ALL SELECT job_id, text FROM src WHERE octet_length(encode(text)) <= {CUT_BYTES}"""


def _triage_sql_ctes() -> str:
    """rule triage, gate, alert texts over the ``analysis`` CTE."""
    q = D.q
    nl = "chr(10)"
    steps = [f"  {i}. {x}" for i, x in enumerate(R.RULE_TRIAGE_MITIGATION, 1)]
    fixes = [f"  {RP.BULLET} {x}" for x in R.RULE_TRIAGE_FIX]
    cfg = [f"  {k} = {v}" for k, v in R.RULE_TRIAGE_CONFIG]
    notes = dict(R.RULE_TRIAGE_NOTES)
    body_parts = [
        q(RP.BODY_TITLE), q(RP.BODY_RULE),
        "'Job:         ' || job_id", "'Platform:    ' || platform", "'Spark:       ' || spark_version",
        "'Severity:    ' || severity", "'Category:    ' || category", "'Confidence:  ' || confidence",
        "'Time:        ' || timestamp",
        "''", q(RP.BODY_SIGNATURE), "failure_signature", "''", q(RP.BODY_ROOT_CAUSE), "root_cause",
        "''", q(RP.BODY_MITIGATION), *[q(x) for x in steps],
        "''", q(RP.BODY_FIX), *[q(x) for x in fixes],
        "''", q(RP.BODY_CONFIG), *[q(x) for x in cfg],
        "''", q(RP.BODY_NOTES),
        q("  Impact:   " + notes.get("impact", "N/A")),
        q("  Resolution: " + notes.get("resolution", "N/A")),
        q("  Prevention: " + notes.get("preventive_actions", "N/A")),
        "''", f"{q('— ' + RP.DEFAULT_FOOTER + ' | ')} || timestamp",
    ]
    return f"""
triage AS (
  SELECT job_id, platform, spark_version,
         coalesce(primary_category, 'Spark') AS category, 'High' AS confidence,
         coalesce(primary_severity, 'HIGH') AS severity,
         CASE WHEN primary_label IS NULL THEN 'Unknown' ELSE left(primary_evidence1, 100) END AS failure_signature,
         {q(R.RULE_TRIAGE_ROOT_CAUSE)} AS root_cause,
         {q("|".join(R.RULE_TRIAGE_MITIGATION))} AS immediate_mitigation,
         {q("|".join(R.RULE_TRIAGE_FIX))} AS permanent_fix,
         {q("|".join(R.RULE_TRIAGE_VERIFY))} AS verify_steps,
         {q("|".join(k + "=" + v for k, v in R.RULE_TRIAGE_CONFIG))} AS spark_config_recommendations,
         {q("|".join(k + "=" + v for k, v in R.RULE_TRIAGE_NOTES))} AS incident_notes,
         'mock' AS model_used, CAST(0 AS BIGINT) AS tokens_used, {q(AS_OF)} AS timestamp
  FROM analysis),
gated AS (SELECT * FROM triage WHERE severity IN ('CRITICAL', 'HIGH')),
alert_texts AS (
  SELECT job_id, severity,
         '[' || severity || '] Spark Job Failed: ' || job_id || ' | ' || category || ' | '
           || left(failure_signature, 60) AS subject,
         concat_ws({nl}, {", ".join(body_parts)}) AS body
  FROM triage),
recipients AS (
  SELECT trim(UNNEST(string_split({q(R.DEFAULT_RECIPIENTS)}, ','))) AS recipient),
outbox AS (
  SELECT a.job_id, r.recipient, a.severity, a.subject, a.body
  FROM alert_texts a JOIN gated g USING (job_id) CROSS JOIN recipients r)"""


def _prompt_sql() -> str:
    q = D.q
    nl = "chr(10)"
    return f"""
SELECT job_id, concat_ws({nl},
  {q(RP.PROMPT_HEADER)},
  'Job Name:      ' || job_id, 'Platform:      ' || platform, 'Spark Version: ' || spark_version,
  'Total Lines:   ' || total_log_lines, 'Error Count:   ' || error_count, 'Warn Count:    ' || warn_count,
  'Executors Lost:' || executors_lost, 'OOM Events:    ' || oom_events,
  'Shuffle Fails: ' || shuffle_failures,
  'Failed Stages: ' || CASE WHEN failed_stages = '' THEN 'none' ELSE replace(failed_stages, ',', ', ') END,
  'Task Retries:  ' || task_retries, '',
  CASE WHEN primary_label IS NOT NULL THEN concat_ws({nl},
    {q(RP.PROMPT_PRIMARY)}, 'Category: ' || primary_category, 'Pattern:  ' || primary_label,
    'Severity: ' || primary_severity, 'Evidence lines:',
    '  ' || replace(primary_evidence, {nl}, {nl} || '  '),
    CASE WHEN length(primary_stack) > 0 THEN concat_ws({nl}, '', 'Stack trace:', left(primary_stack, {R.PROMPT_STACK_CHARS})) END,
    '') END,
  CASE WHEN n_signals > 0 THEN concat_ws({nl}, {q(RP.PROMPT_ALL)}, signal_lines, '') END,
  {q(RP.PROMPT_EXCERPT)},
  CASE WHEN raw_error_snippet = '' THEN '(none)' ELSE left(raw_error_snippet, {R.PROMPT_EXCERPT_CHARS}) END,
  '', {q(RP.PROMPT_TAIL)},
  CASE WHEN log_tail = '' THEN '(none)' ELSE right(log_tail, {R.PROMPT_TAIL_CHARS}) END,
  '', {q(RP.PROMPT_CLOSE)}) AS prompt
FROM analysis"""


def _failure_ctes() -> str:
    """failures rendered from error events, normalised; candidate paths; files."""
    q = D.q
    base = LOG_BASE
    return f"""
err AS (
  SELECT event_id, user_id, ts, strftime(ts, '%Y-%m-%d %H:%M:%S') AS date,
         replace(replace({D._template_case()}, '@', strftime(ts, '%y/%m/%d %H:%M:%S')),
                 '#', CAST(event_id % 7 AS VARCHAR)) AS block
  FROM events WHERE event_type = 'error'),
fctx AS (
  SELECT CAST(event_id AS VARCHAR) AS failure_id,
         'dag_' || CAST(user_id % 10 AS VARCHAR) AS dag_id,
         'task_' || CAST(event_id % 3 AS VARCHAR) AS task_id,
         CASE WHEN event_id % 7 <> 0 THEN 'run_' || CAST(event_id AS VARCHAR) ELSE 'manual' END AS run_id,
         date AS execution_date,
         CAST(event_id % 3 + 1 AS INTEGER) AS try_number,
         'SparkSubmitOperator' AS operator,
         'worker-' || CAST(event_id % 4 AS VARCHAR) AS hostname,
         'http://logs/' || CAST(event_id AS VARCHAR) AS log_url,
         CASE WHEN event_id % 4 <> 0 THEN block ELSE '' END AS exception
  FROM err),
fcand AS (
  SELECT *, {q(base)} || '/' || dag_id || '/' || task_id || '/' || regexp_replace(execution_date, '[:\\s]', '_', 'g')
              || '/' || CAST(try_number AS VARCHAR) || '.log' AS c1,
            {q(base)} || '/' || dag_id || '/' || task_id || '/' || regexp_replace(execution_date, '[:\\s]', '_', 'g')
              || {q(AF.DATE_SUFFIX)} || '/' || CAST(try_number AS VARCHAR) || '.log' AS c2
  FROM fctx),
ffiles AS (
  SELECT CASE CAST(failure_id AS BIGINT) % 3 WHEN 0 THEN c1 WHEN 1 THEN c2
              ELSE {q(base)} || '/' || dag_id || '/' || task_id || '/'
                   || regexp_replace(execution_date, '[:\\s]', '_', 'g') || '/'
                   || CAST(try_number + 1 AS VARCHAR) || '.log' END AS path,
         CASE WHEN CAST(failure_id AS BIGINT) % 11 = 0 THEN '' ELSE exception END AS text
  FROM fcand),
flocated AS (
  SELECT f.*, CASE WHEN EXISTS (SELECT 1 FROM ffiles x WHERE x.path = f.c1) THEN f.c1
                   WHEN EXISTS (SELECT 1 FROM ffiles x WHERE x.path = f.c2) THEN f.c2 END AS log_path
  FROM fcand f)"""


_FLAT_ANALYSIS_SELECT = (
    "SELECT job_id, platform, spark_version, total_log_lines, error_count, warn_count, "
    "executors_lost, oom_events, shuffle_failures, task_retries, failed_stages, "
    "primary_label, primary_category, primary_severity, n_signals, signal_list, "
    "raw_error_snippet, log_tail FROM analysis")


def _error_subset_sql() -> str:
    """Analysis of the first 150 error lines per job (the Spark-path scope):
    the analysis CTEs run again in a nested scope where ``lines`` is the
    renumbered subset; tail and total come from all lines."""
    sub = f"""
sub_src AS (
  SELECT job_id, CAST(k AS BIGINT) AS line_no, CAST(k AS BIGINT) AS idx, value FROM (
    SELECT job_id, value, row_number() OVER (PARTITION BY job_id ORDER BY line_no) AS k
    FROM (SELECT *, {_level_anywhere_sql()} AS level FROM labelled)
    WHERE level IN ('ERROR', 'FATAL') OR label IS NOT NULL)
  WHERE k <= {R.ERROR_SUBSET_LINES}),
full_tail AS (
  SELECT job_id, string_agg(value, chr(10) ORDER BY line_no) AS log_tail FROM (
    SELECT job_id, line_no, value, row_number() OVER (PARTITION BY job_id ORDER BY line_no DESC) AS r
    FROM lines) WHERE r <= {R.TAIL_LINES} GROUP BY job_id),
totals AS (SELECT job_id, count(*) AS total FROM lines GROUP BY job_id)"""
    inner = ("(WITH lines AS (SELECT * FROM sub_src)," + D.analysis_ctes() + "\nSELECT * FROM analysis)")
    body = f"""
SELECT t.job_id, coalesce(a.platform, 'unknown') AS platform,
       coalesce(a.spark_version, 'unknown') AS spark_version, t.total AS total_log_lines,
       coalesce(a.error_count, 0) AS error_count, coalesce(a.warn_count, 0) AS warn_count,
       coalesce(a.executors_lost, 0) AS executors_lost, coalesce(a.oom_events, 0) AS oom_events,
       coalesce(a.shuffle_failures, 0) AS shuffle_failures, coalesce(a.task_retries, 0) AS task_retries,
       coalesce(a.failed_stages, '') AS failed_stages, a.primary_label, a.primary_category,
       a.primary_severity, coalesce(a.n_signals, 0) AS n_signals, coalesce(a.signal_list, '') AS signal_list,
       coalesce(a.raw_error_snippet, '') AS raw_error_snippet, coalesce(ft.log_tail, '') AS log_tail
FROM totals t LEFT JOIN {inner} a USING (job_id) LEFT JOIN full_tail ft USING (job_id)"""
    return D.with_corpus(body, sub)


def _sql_list(xs) -> str:
    return "[" + ", ".join(D.q(x) for x in xs) + "]"


def _sql_map(kv) -> str:
    return "MAP {" + ", ".join(f"{D.q(k)}: {D.q(v)}" for k, v in kv) + "}"


def _replies_sql(body: str) -> str:
    """The derived model replies and their parsing, over the rule triage."""
    q = D.q

    def arr(xs):
        return "[" + ", ".join(q(x) for x in xs) + "]"

    def mp(kv):
        return "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in kv) + "}"

    strip = lambda c: D.strip(c)

    def fmap(path):
        return (f"array_to_string(list_transform(map_entries(CAST(json_extract(jt, '$.{path}') "
                f"AS MAP(VARCHAR, VARCHAR))), lambda e: e.key || '=' || e.value), '|')")

    def present(key):
        return f"json_exists(jt, '$.{key}')"

    def text(key, default):
        return f"CASE WHEN {present(key)} THEN json_extract_string(jt, '$.{key}') ELSE {q(default)} END"

    def lst(key):
        return f"CASE WHEN {present(key)} THEN array_to_string(CAST(json_extract(jt, '$.{key}') AS VARCHAR[]), '|') ELSE '' END"

    span = "regexp_extract(c, '(?s)(\\{.*\\})', 1)"
    ctes = f"""
replies AS (
  SELECT job_id, failure_signature,
         json_object('category', category, 'confidence', confidence, 'severity', severity,
                     'failure_signature', failure_signature, 'root_cause', root_cause,
                     'immediate_mitigation', {arr(R.RULE_TRIAGE_MITIGATION)},
                     'permanent_fix', {arr(R.RULE_TRIAGE_FIX)}, 'verify_steps', {arr(R.RULE_TRIAGE_VERIFY)},
                     'spark_config_recommendations', {mp(R.RULE_TRIAGE_CONFIG)},
                     'incident_notes', {mp(R.RULE_TRIAGE_NOTES)})::VARCHAR AS js,
         CAST(regexp_extract(job_id, '(\\d+)$', 1) AS BIGINT) % 7 AS k
  FROM triage),
raw_replies AS (
  SELECT job_id, CAST(length(js) // 4 AS BIGINT) AS tokens,
         CASE k WHEN 0 THEN js
                WHEN 1 THEN '```json' || chr(10) || js || chr(10) || '```'
                WHEN 2 THEN 'Here is the triage: ' || js || ' Thanks.'
                WHEN 3 THEN '[' || js || ']'
                WHEN 4 THEN '{{"category": "Infra", "severity": null, "permanent_fix": ["a", "b"]}}'
                WHEN 5 THEN 'No JSON here, only prose about ' || failure_signature
                ELSE '' END AS raw
  FROM replies),
cleaned AS (
  SELECT job_id, tokens, {strip("replace(replace(" + strip("raw") + ", '```json', ''), '```', '')")} AS c
  FROM raw_replies),
parsed_replies AS (
  SELECT job_id, tokens, c,
         CASE WHEN json_valid(c) THEN CASE WHEN json_type(c) = 'OBJECT' THEN c END
              WHEN json_valid({span}) AND json_type({span}) = 'OBJECT' THEN {span} END AS jt
  FROM cleaned),
reply_triage AS (
  SELECT job_id, jt IS NOT NULL AS parsed,
         CASE WHEN jt IS NOT NULL THEN {text("category", "Spark")} ELSE 'Spark' END AS category,
         CASE WHEN jt IS NOT NULL THEN {text("confidence", "Medium")} ELSE 'Low' END AS confidence,
         CASE WHEN jt IS NOT NULL THEN {text("severity", "HIGH")} ELSE 'HIGH' END AS severity,
         CASE WHEN jt IS NOT NULL THEN {text("failure_signature", "Unknown failure")} ELSE left(c, 200) END AS failure_signature,
         CASE WHEN jt IS NOT NULL THEN {text("root_cause", "")} ELSE left(c, 500) END AS root_cause,
         CASE WHEN jt IS NOT NULL THEN {lst("immediate_mitigation")} ELSE {q("|".join(R.FALLBACK_MITIGATION))} END AS immediate_mitigation,
         CASE WHEN jt IS NOT NULL THEN {lst("permanent_fix")} ELSE {q("|".join(R.FALLBACK_FIX))} END AS permanent_fix,
         CASE WHEN jt IS NOT NULL THEN {lst("verify_steps")} ELSE {q("|".join(R.FALLBACK_VERIFY))} END AS verify_steps,
         CASE WHEN jt IS NOT NULL AND {present("spark_config_recommendations")} THEN {fmap("spark_config_recommendations")} ELSE '' END
           AS spark_config_recommendations,
         CASE WHEN jt IS NULL THEN {q("|".join(k + "=" + v for k, v in R.FALLBACK_NOTES))}
              WHEN {present("incident_notes")} THEN {fmap("incident_notes")} ELSE '' END AS incident_notes,
         CASE WHEN jt IS NULL THEN 0 WHEN {present("permanent_fix")}
              THEN len(CAST(json_extract(jt, '$.permanent_fix') AS VARCHAR[])) ELSE 0 END AS n_fix_obj,
         'replay' AS model_used, tokens AS tokens_used, {q(AS_OF)} AS timestamp
  FROM parsed_replies)"""
    return D.with_corpus(body, _triage_sql_ctes() + "," + ctes)


def _failure_triage_sql(body: str, folder: bool = False) -> str:
    """Analysis and rule triage over the resolved failure texts; ``folder``: of the long logs that are cut to their last bytes."""
    crlf = "CAST(regexp_extract(path, '([0-9]+)[.]log$', 1) AS BIGINT) % 2 = 0"
    long = f"repeat({D.q(FILLER.rstrip())} || chr(10), {FILLER_TIMES}) || max(text)"
    logs = f""",
ftails AS (SELECT path, CASE WHEN max(text) = '' THEN '' WHEN {crlf} THEN right(replace({long}, chr(10), chr(13) || chr(10)), {CUT_BYTES})
                             ELSE right({long}, {CUT_BYTES}) END AS text FROM ffiles GROUP BY path)""" if folder else ""
    resolved = logs + """,
resolved AS (
  SELECT l.failure_id, l.dag_id, l.task_id, l.run_id, l.execution_date, l.try_number, l.operator,
         l.log_url,
         coalesce(nullif(f.text, ''),
                  CASE WHEN l.exception <> '' THEN 'Airflow task failure — no log file found.' || chr(10)
                       || 'DAG: ' || l.dag_id || ' | Task: ' || l.task_id || ' | Run: ' || l.run_id || chr(10)
                       || 'Exception:' || chr(10) || l.exception END,
                  'Airflow task ' || l.dag_id || '.' || l.task_id || ' failed. No log available.') AS log_text
  FROM flocated l LEFT JOIN """ + ("ftails" if folder else "ffiles") + """ f ON f.path = l.log_path)"""
    ctes = (_failure_ctes() + resolved + "," + D.text_lines_sql("resolved", "failure_id", "log_text")
            + ",\nlines AS (SELECT job_id, line_no, idx, value FROM text_lines)," + D.analysis_ctes()
            + "," + _triage_sql_ctes())
    return "WITH " + ctes + "\n" + body


# --------------------------------------------------------------------------
# Contract
# --------------------------------------------------------------------------

def entry(spark: SparkSession) -> DataFrame:
    return _QUERIES["triage_report"](spark, "/root/testdata/sf0.001")


def _training_data() -> tuple[dict, dict]:
    """Queries and statements of the training-data operators, if that subpackage is there."""
    try:
        from logsieve.llm import queries as L
    except ImportError as e:
        if e.name != "logsieve.llm":  # the subpackage is there, something that it needs is not
            raise
        return {}, {}
    return L.QUERIES, L.ORACLES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**_QUERIES, **_training_data()[0]}


def oracle_sql() -> dict[str, str]:
    o = _oracles()
    return {**{k: v for k, v in o.items() if k in _QUERIES}, **_training_data()[1]}
