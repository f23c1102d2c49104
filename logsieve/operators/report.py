"""Triage records, prompts, reply parsing and alert texts.

All are per-row projections over per-job tables (one analysis row per job),
built from built-in string, array, map and VARIANT functions.

Triage schema: job_id, category, confidence, severity, failure_signature,
root_cause, immediate_mitigation, permanent_fix, verify_steps (ARRAY<STRING>),
spark_config_recommendations, incident_notes (MAP<STRING,STRING>),
model_used, tokens_used, timestamp.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.regex import py_strip

TRIAGE_COLUMNS = [
    "job_id", "category", "confidence", "severity", "failure_signature", "root_cause",
    "immediate_mitigation", "permanent_fix", "verify_steps", "spark_config_recommendations",
    "incident_notes", "model_used", "tokens_used", "timestamp",
]

# FIXED VALUES: alert body texts.
BODY_TITLE = "🚨 SPARK JOB FAILURE ALERT"
BODY_RULE = "=" * 60
BODY_SIGNATURE = "🔍 FAILURE SIGNATURE"
BODY_ROOT_CAUSE = "🔎 ROOT CAUSE"
BODY_MITIGATION = "🛠  IMMEDIATE MITIGATION"
BODY_FIX = "🧱 PERMANENT FIX"
BODY_CONFIG = "⚙️  SPARK CONFIG RECOMMENDATIONS"
BODY_NOTES = "📌 INCIDENT NOTES"
BULLET = "•"
DEFAULT_FOOTER = "logsieve"

# FIXED VALUES: prompt texts.
PROMPT_HEADER = "=== SPARK JOB FAILURE REPORT ==="
PROMPT_PRIMARY = "=== PRIMARY FAILURE SIGNAL (pattern-matched) ==="
PROMPT_ALL = "=== ALL DETECTED SIGNALS ==="
PROMPT_EXCERPT = "=== RAW ERROR EXCERPT ==="
PROMPT_TAIL = "=== LOG TAIL (last 100 lines) ==="
PROMPT_CLOSE = "Respond ONLY with the JSON structure defined in your system prompt. No markdown, no preamble."


def _str_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _str_map(pairs) -> Column:
    if not pairs:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(x) for kv in pairs for x in kv])


def _fmt(c: Column) -> Column:
    """Python f-string of an optional value: None prints as 'None'."""
    return F.coalesce(c.cast("string"), F.lit("None"))


# --------------------------------------------------------------------------
# T5: rule-based triage (no model)
# --------------------------------------------------------------------------

def rule_triage(analysis: DataFrame, keep: list | None = None) -> DataFrame:
    """Triage from the primary signal alone (T5).

    Category and severity of the primary (Spark / HIGH if none), confidence
    High, signature = first 100 characters of the first evidence line (or
    'Unknown'), fixed lists and one config hint. Clean jobs are kept (they
    triage as HIGH, as the reference does); filter ``primary_signal`` first
    for failed jobs only. ``keep`` adds columns of the analysis row.
    """
    p = F.col("primary_signal")
    return analysis.select(
        *(keep or []),
        "job_id",
        F.coalesce(p["category"], F.lit("Spark")).alias("category"),
        F.lit("High").alias("confidence"),
        F.coalesce(p["severity"], F.lit("HIGH")).alias("severity"),
        F.when(p.isNull(), F.lit("Unknown"))
        .otherwise(F.substring(F.get(p["evidence"], 0), 1, 100)).alias("failure_signature"),
        F.lit(R.RULE_TRIAGE_ROOT_CAUSE).alias("root_cause"),
        _str_array(R.RULE_TRIAGE_MITIGATION).alias("immediate_mitigation"),
        _str_array(R.RULE_TRIAGE_FIX).alias("permanent_fix"),
        _str_array(R.RULE_TRIAGE_VERIFY).alias("verify_steps"),
        _str_map(R.RULE_TRIAGE_CONFIG).alias("spark_config_recommendations"),
        _str_map(R.RULE_TRIAGE_NOTES).alias("incident_notes"),
        F.lit("mock").alias("model_used"),
        F.lit(0).cast("bigint").alias("tokens_used"),
        F.col("timestamp"),
    )


# --------------------------------------------------------------------------
# Alert gate, texts, outbox
# --------------------------------------------------------------------------

def alert_gate(triage: DataFrame, severities=None, force: Column | bool = False) -> DataFrame:
    """Triage rows that alert (R14): ``force`` or severity in the set (an empty set: none)."""
    sev = list(R.DEFAULT_ALERT_SEVERITIES if severities is None else severities)
    f = force if isinstance(force, Column) else F.lit(bool(force))
    return triage.filter(f | F.col("severity").isin(sev))


def alert_subject(job: Column | None = None) -> Column:
    """``[sev] Spark Job Failed: job | category | signature[:60]``."""
    job = job if job is not None else F.lit("unknown")
    return F.concat(
        F.lit("["), _fmt(F.col("severity")), F.lit("] Spark Job Failed: "), _fmt(job),
        F.lit(" | "), _fmt(F.col("category")), F.lit(" | "),
        F.substring(_fmt(F.col("failure_signature")), 1, 60),
    )


def _note(key: str) -> Column:
    m = F.col("incident_notes")
    return F.when(F.map_contains_key(m, F.lit(key)), _fmt(m[key])).otherwise(F.lit("N/A"))


def alert_body(job: Column | None = None, platform: Column | None = None,
               spark_version: Column | None = None, footer: str = DEFAULT_FOOTER) -> Column:
    """Plain-text alert body (T8): header fields, signature, root cause,
    numbered mitigation, bulleted fixes, config section only when there is
    config, three incident notes ('N/A' when missing), footer with time."""
    na = F.lit("N/A")
    job = _fmt(job) if job is not None else na
    platform = _fmt(platform) if platform is not None else na
    spark_version = _fmt(spark_version) if spark_version is not None else na
    ts = _fmt(F.col("timestamp"))
    head = F.array(
        F.lit(BODY_TITLE), F.lit(BODY_RULE),
        F.concat(F.lit("Job:         "), job),
        F.concat(F.lit("Platform:    "), platform),
        F.concat(F.lit("Spark:       "), spark_version),
        F.concat(F.lit("Severity:    "), _fmt(F.col("severity"))),
        F.concat(F.lit("Category:    "), _fmt(F.col("category"))),
        F.concat(F.lit("Confidence:  "), _fmt(F.col("confidence"))),
        F.concat(F.lit("Time:        "), ts),
        F.lit(""), F.lit(BODY_SIGNATURE), _fmt(F.col("failure_signature")),
        F.lit(""), F.lit(BODY_ROOT_CAUSE), _fmt(F.col("root_cause")),
        F.lit(""), F.lit(BODY_MITIGATION),
    )
    steps = F.transform(
        F.coalesce(F.col("immediate_mitigation"), F.array().cast("array<string>")),
        lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), _fmt(x)),
    )
    fixes = F.transform(
        F.coalesce(F.col("permanent_fix"), F.array().cast("array<string>")),
        lambda x: F.concat(F.lit(f"  {BULLET} "), _fmt(x)),
    )
    cfg = F.coalesce(F.col("spark_config_recommendations"), F.create_map().cast("map<string,string>"))
    cfg_lines = F.when(
        F.size(cfg) > 0,
        F.concat(
            F.array(F.lit(""), F.lit(BODY_CONFIG)),
            F.transform(F.map_entries(cfg),
                        lambda e: F.concat(F.lit("  "), e["key"], F.lit(" = "), _fmt(e["value"]))),
        ),
    ).otherwise(F.array().cast("array<string>"))
    tail = F.array(
        F.lit(""), F.lit(BODY_NOTES),
        F.concat(F.lit("  Impact:   "), _note("impact")),
        F.concat(F.lit("  Resolution: "), _note("resolution")),
        F.concat(F.lit("  Prevention: "), _note("preventive_actions")),
        F.lit(""),
        F.concat(F.lit(f"— {footer} | "), ts),
    )
    return F.array_join(
        F.concat(head, steps, F.array(F.lit(""), F.lit(BODY_FIX)), fixes, cfg_lines, tail), "\n"
    )


def alert_text(triage_with_ctx: DataFrame, footer: str = DEFAULT_FOOTER) -> DataFrame:
    """Subject and body per triage row; needs job_id, platform, spark_version
    next to the triage columns (T7, T8). Texts name the job by ``job_name`` if there is one."""
    named = "job_name" in triage_with_ctx.columns
    name = F.coalesce("job_name", "job_id") if named else F.col("job_id")
    return triage_with_ctx.select(
        "job_id", "severity",
        alert_subject(name).alias("subject"),
        alert_body(name, F.col("platform"), F.col("spark_version"), footer).alias("body"),
    )


def alert_outbox(alerts: DataFrame, recipients: str | Column | None = None) -> DataFrame:
    """One row per (alert, recipient) (K3). Recipients are a comma list, each
    stripped; a column allows a per-row override."""
    if recipients is None:
        recipients = R.DEFAULT_RECIPIENTS
    rc = recipients if isinstance(recipients, Column) else F.lit(recipients)
    rlist = F.transform(F.split(rc, ","), lambda x: py_strip(x))
    return alerts.select("*", F.explode(rlist).alias("recipient"))


# --------------------------------------------------------------------------
# prompt
# --------------------------------------------------------------------------

#: Instructions to go with a prompt, which ends by referring to them. The keys are those ``parse_response`` reads.
MODEL_INSTRUCTIONS = """You are a reliability engineer who explains failed Spark jobs from the evidence in a report.
Answer with one JSON object and nothing else. Its keys:
  category                      string, the kind of failure
  confidence                    string: High, Medium or Low
  severity                      string: CRITICAL, HIGH, MEDIUM or LOW
  failure_signature             string, the failure in one line
  root_cause                    string, what went wrong and why
  immediate_mitigation          list of strings, steps to take now
  permanent_fix                 list of strings, changes that keep it from coming back
  verify_steps                  list of strings, how to see that the fix works
  spark_config_recommendations  object of strings, setting to value
  incident_notes                object of strings with impact, resolution, preventive_actions, start_time
Say nothing that the report does not support."""


def build_prompt(analysis: DataFrame, evidence_n: int = R.PROMPT_EVIDENCE,
                 stack_chars: int = R.PROMPT_STACK_CHARS, excerpt_chars: int = R.PROMPT_EXCERPT_CHARS,
                 tail_chars: int = R.PROMPT_TAIL_CHARS, instructions: str | None = None) -> DataFrame:
    """The fixed-layout failure report sent to a model, one per job (T2); with ``instructions``
    (such as ``MODEL_INSTRUCTIONS``) they go along in a column ``system``."""
    c = F.col("job_context")
    p = F.col("primary_signal")
    stages = F.array_join(c["failed_stages"], ", ")
    head = F.array(
        F.lit(PROMPT_HEADER),
        F.concat(F.lit("Job Name:      "), c["job_name"]),
        F.concat(F.lit("Platform:      "), c["platform"]),
        F.concat(F.lit("Spark Version: "), c["spark_version"]),
        F.concat(F.lit("Total Lines:   "), c["total_log_lines"].cast("string")),
        F.concat(F.lit("Error Count:   "), c["error_count"].cast("string")),
        F.concat(F.lit("Warn Count:    "), c["warn_count"].cast("string")),
        F.concat(F.lit("Executors Lost:"), c["executors_lost"].cast("string")),
        F.concat(F.lit("OOM Events:    "), c["oom_events"].cast("string")),
        F.concat(F.lit("Shuffle Fails: "), c["shuffle_failures"].cast("string")),
        F.concat(F.lit("Failed Stages: "), F.when(stages == "", F.lit("none")).otherwise(stages)),
        F.concat(F.lit("Task Retries:  "), c["task_retries"].cast("string")),
        F.lit(""),
    )
    empty = F.array().cast("array<string>")
    primary = F.when(
        p.isNotNull(),
        F.concat(
            F.array(
                F.lit(PROMPT_PRIMARY),
                F.concat(F.lit("Category: "), p["category"]),
                F.concat(F.lit("Pattern:  "), p["label"]),
                F.concat(F.lit("Severity: "), p["severity"]),
                F.lit("Evidence lines:"),
            ),
            F.transform(F.slice(p["evidence"], 1, evidence_n), lambda x: F.concat(F.lit("  "), x)),
            F.when(F.length(p["stack_trace"]) > 0,
                   F.array(F.lit(""), F.lit("Stack trace:"), F.substring(p["stack_trace"], 1, stack_chars)))
            .otherwise(empty),
            F.array(F.lit("")),
        ),
    ).otherwise(empty)
    sigs = F.col("all_signals")
    all_sigs = F.when(
        F.size(sigs) > 0,
        F.concat(
            F.array(F.lit(PROMPT_ALL)),
            F.transform(sigs, lambda s: F.concat(
                F.lit("  ["), s["severity"], F.lit("] "), s["label"], F.lit(" ("), s["category"],
                F.lit("): "), s["n"].cast("string"), F.lit(" occurrence(s)"))),
            F.array(F.lit("")),
        ),
    ).otherwise(empty)
    snip = F.col("raw_error_snippet")
    tail = F.col("log_tail")
    rest = F.array(
        F.lit(PROMPT_EXCERPT),
        F.when(F.length(snip) > 0, F.substring(snip, 1, excerpt_chars)).otherwise(F.lit("(none)")),
        F.lit(""),
        F.lit(PROMPT_TAIL),
        F.when(F.length(tail) > 0, F.right(tail, F.lit(tail_chars))).otherwise(F.lit("(none)")),
        F.lit(""),
        F.lit(PROMPT_CLOSE),
    )
    return analysis.select("job_id", F.array_join(F.concat(head, primary, all_sigs, rest), "\n").alias("prompt"),
                           *([] if instructions is None else [F.lit(instructions).alias("system")]))


# --------------------------------------------------------------------------
# Model replies -> triage rows
# --------------------------------------------------------------------------

def _cleaned(raw: Column) -> Column:
    """strip, drop every ``` fence mark (with or without json), strip."""
    s = py_strip(F.coalesce(raw, F.lit("")))
    s = F.replace(F.replace(s, F.lit("```json"), F.lit("")), F.lit("```"), F.lit(""))
    return py_strip(s)


# FIXED VALUES: the numbers that Python's JSON reader takes beyond JSON's, where they stand alone.
_PYTHON_NUMBERS = r"(?<![\w.+-])(NaN|-?Infinity)(?![\w.])"


def _with_python_numbers(c: Column) -> Column:
    """``c`` with NaN and the infinities as strings, wherever they stand outside of strings."""
    parts = F.regexp_extract_all(c, F.lit(r'(?s)"(?:[^"\\]++|\\.)*+"|[^"]++|"'), F.lit(0))
    fixed = F.transform(parts, lambda x: F.when(x.startswith('"'), x).otherwise(F.regexp_replace(x, _PYTHON_NUMBERS, '"$1"')))
    return F.when(c.rlike(_PYTHON_NUMBERS), F.array_join(fixed, "")).otherwise(c)


def _objects(c: Column) -> Column:
    """How many objects stand side by side in a text: braces, outside of strings, that close the outermost one."""
    plain = F.regexp_replace(c, r'(?s)"(?:[^"\\]++|\\.)*+"', "")
    braces = F.split(F.regexp_replace(plain, "[^{}]", ""), "")
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"))

    def step(a: Column, b: Column) -> Column:
        depth = a["depth"] + F.when(b == "{", 1).when(b == "}", -1).otherwise(0)
        return F.struct(depth.alias("depth"), (a["n"] + F.when((b == "}") & (depth == 0), 1).otherwise(0)).alias("n"))

    return F.aggregate(braces, zero, step, lambda a: a["n"])


def _last_wins(m: Column) -> Column:
    """A map each of whose keys keeps its first place and its last value, as JSON's maps may repeat keys."""
    keys = F.array_distinct(F.map_keys(m))
    last = F.transform(keys, lambda k: F.element_at(F.filter(F.map_entries(m), lambda e: e["key"] == k), -1)["value"])
    return F.when(F.size(keys) < F.size(F.map_keys(m)), F.map_from_arrays(keys, last)).otherwise(m)


def _is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def parse_response(replies: DataFrame, as_of: str) -> DataFrame:
    """Model replies (job_id, raw, model, tokens) to triage rows.

    Parse the cleaned reply as a JSON object; else the span from the first
    '{' to the last '}'; else a fallback row (confidence Low, signature and
    root cause = the first 200 / 500 characters of the cleaned text). Keys
    that are missing take their defaults; a JSON null stays NULL. As for Python's reader, the last of
    equal keys counts (the session's ``spark.sql.variant.allowDuplicateKeys`` is set for it), NaN and the infinities are
    numbers (here: their names), and maps keep the order of their keys.
    """
    replies.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    df = replies.select("*", _cleaned(F.col("raw")).alias("_c")).withColumn("_j", _with_python_numbers(F.col("_c")))
    # Spark's parser stops after one value; of several side by side Python's takes none.
    df = df.withColumn("_j", F.when(_objects(F.col("_j")) <= 1, F.col("_j")))
    v1 = F.try_parse_json(F.col("_j"))
    span = F.regexp_extract(F.col("_j"), r"(?s)(\{.*\})", 1)
    v2 = F.try_parse_json(span)
    df = df.select(
        "*",
        F.when(v1.isNotNull(), F.when(_is_object(v1), v1))
        .otherwise(F.when(_is_object(v2), v2)).alias("_v"),
        F.when(v1.isNotNull(), F.when(_is_object(v1), F.col("_j")))
        .otherwise(F.when(_is_object(v2), span)).alias("_json"),
    )
    v = F.col("_v")

    def present(key):
        return F.variant_get(v, f"$.{key}", "variant").isNotNull()

    def text(key, default):
        return F.when(present(key), F.try_variant_get(v, f"$.{key}", "string")).otherwise(F.lit(default))

    def arr(key):
        return F.when(present(key), F.try_variant_get(v, f"$.{key}", "array<string>")) \
            .otherwise(F.array().cast("array<string>"))

    maps = F.from_json(F.col("_json"), "spark_config_recommendations map<string,string>, "
                                       "incident_notes map<string,string>")

    def mp(key):
        return F.when(present(key), _last_wins(maps[key])).otherwise(F.create_map().cast("map<string,string>"))

    ok = v.isNotNull()
    c = F.col("_c")
    return df.select(
        "job_id",
        F.when(ok, text("category", "Spark")).otherwise(F.lit("Spark")).alias("category"),
        F.when(ok, text("confidence", "Medium")).otherwise(F.lit("Low")).alias("confidence"),
        F.when(ok, text("severity", "HIGH")).otherwise(F.lit("HIGH")).alias("severity"),
        F.when(ok, text("failure_signature", "Unknown failure"))
        .otherwise(F.substring(c, 1, 200)).alias("failure_signature"),
        F.when(ok, text("root_cause", "")).otherwise(F.substring(c, 1, 500)).alias("root_cause"),
        F.when(ok, arr("immediate_mitigation")).otherwise(_str_array(R.FALLBACK_MITIGATION)).alias("immediate_mitigation"),
        F.when(ok, arr("permanent_fix")).otherwise(_str_array(R.FALLBACK_FIX)).alias("permanent_fix"),
        F.when(ok, arr("verify_steps")).otherwise(_str_array(R.FALLBACK_VERIFY)).alias("verify_steps"),
        F.when(ok, mp("spark_config_recommendations"))
        .otherwise(F.create_map().cast("map<string,string>")).alias("spark_config_recommendations"),
        F.when(ok, mp("incident_notes")).otherwise(_str_map(R.FALLBACK_NOTES)).alias("incident_notes"),
        F.col("model").alias("model_used"),
        F.col("tokens").cast("bigint").alias("tokens_used"),
        F.lit(as_of).alias("timestamp"),
        ok.alias("parsed"),
    )


# --------------------------------------------------------------------------
# Incident notes enriched with the failure context
# --------------------------------------------------------------------------

NOTE_KEYS = ["dag_id", "task_id", "run_id", "execution_date", "try_number", "operator", "airflow_log_url"]


def enrich_notes(triage: DataFrame, contexts: DataFrame, on: str = "job_id") -> DataFrame:
    """Merge seven failure-context keys into incident_notes, overwriting.

    ``contexts`` has ``on`` plus dag_id, task_id, run_id, execution_date,
    try_number, operator, log_url.
    """
    ctx = contexts.select(
        on,
        F.create_map(
            F.lit("dag_id"), F.col("dag_id"), F.lit("task_id"), F.col("task_id"),
            F.lit("run_id"), F.col("run_id"), F.lit("execution_date"), F.col("execution_date"),
            F.lit("try_number"), F.col("try_number").cast("string"), F.lit("operator"), F.col("operator"),
            F.lit("airflow_log_url"), F.coalesce(F.col("log_url"), F.lit("")),
        ).alias("_ctx_notes"),
    )
    keys = F.array(*[F.lit(k) for k in NOTE_KEYS])
    return triage.join(ctx, on, "left").withColumn(
        "incident_notes",
        F.when(F.col("_ctx_notes").isNull(), F.col("incident_notes")).otherwise(
            F.map_concat(
                F.map_filter(F.coalesce("incident_notes", F.create_map().cast("map<string,string>")),
                             lambda k, _v: ~F.array_contains(keys, k)),
                F.col("_ctx_notes"),
            )
        ),
    ).drop("_ctx_notes")


def _context_dict(c: Column) -> Column:
    """The 14 keys of a serialised job context; three of them are always null."""
    return F.struct(
        *[c[f].alias(f) for f in ("job_name", "platform", "spark_version", "total_log_lines",
                                   "error_count", "warn_count", "failed_stages", "executors_lost",
                                   "oom_events", "shuffle_failures", "task_retries")],
        F.lit(None).cast("double").alias("duration_seconds"),
        F.lit(None).cast("string").alias("start_time"),
        F.lit(None).cast("string").alias("end_time"),
    )


_KEEP_NULLS = {"ignoreNullFields": "false"}


def triage_json(triage: DataFrame, analysis: DataFrame | None = None) -> DataFrame:
    """Serialised triage records (K2): 13 keys, plus job_context with its 14
    when the analysis is given. Keys whose value is null stay."""
    cols = [c for c in TRIAGE_COLUMNS if c != "job_id"]
    if analysis is None:
        return triage.select("job_id", F.to_json(F.struct(*cols), _KEEP_NULLS).alias("json"))
    j = triage.join(analysis.select("job_id", _context_dict(F.col("job_context")).alias("job_context")), "job_id", "left")
    return j.select("job_id", F.to_json(F.struct(*cols, "job_context"), _KEEP_NULLS).alias("json"))


def _signal_dict(s: Column) -> Column:
    return F.struct(
        s["category"].alias("category"), s["label"].alias("pattern_matched"),
        s["severity"].alias("severity"), s["evidence"].alias("evidence_lines"),
        s["stack_trace"].alias("stack_trace"),
    )


def analysis_json(analysis: DataFrame) -> DataFrame:
    """Serialised analysis (K1): job_context, primary_signal (null if none),
    all_signals, raw_error_snippet, timestamp; log_tail left out.

    A signal has the evidence lines that the analysis holds: all of them unless
    ``analyze`` was given an ``evidence_cap``.
    """
    p = F.col("primary_signal")
    return analysis.select(
        "job_id",
        F.to_json(
            F.struct(
                _context_dict(F.col("job_context")).alias("job_context"),
                F.when(p.isNotNull(), _signal_dict(p)).alias("primary_signal"),
                F.transform("all_signals", _signal_dict).alias("all_signals"),
                "raw_error_snippet", "timestamp",
            ),
            _KEEP_NULLS,
        ).alias("json"),
    )


# --------------------------------------------------------------------------
# K1 for analyses of any size: the record in pieces
# --------------------------------------------------------------------------

_LAST = (1 << 63) - 1


def _json(value: Column) -> Column:
    """A scalar as JSON text."""
    one = F.to_json(F.array(value))
    return F.substring(one, F.lit(2), F.length(one) - 2)


def _signal_head(s: Column) -> Column:
    return F.concat(F.lit('{"category":'), _json(s["category"]), F.lit(',"pattern_matched":'), _json(s["label"]), F.lit(',"severity":'),
                    _json(s["severity"]), F.lit(',"evidence_lines":['))


def _signal_end(s: Column) -> Column:
    return F.concat(F.lit('],"stack_trace":'), _json(s["stack_trace"]), F.lit("}"))


def analysis_pieces(analysis: DataFrame, evidence: DataFrame) -> DataFrame:
    """The records of ``analysis_json`` with every evidence line, in pieces: (job_id, section, rank, idx, piece).

    A job's pieces, in the order of (section, rank, idx), are its record; white space may stand between them. Each evidence line is a
    piece of its own, taken from the long table ``evidence`` (job_id, label, idx, line), so no row and no task holds a job's
    evidence, however many hits it has. The evidence arrays of ``analysis`` are not read.
    """
    p, none = F.col("primary_signal"), F.lit(0).cast("bigint")
    order = lambda section, rank=F.lit(0), idx=none: [F.lit(section).alias("section"), rank.cast("int").alias("rank"), idx.alias("idx")]
    head = analysis.select("job_id", *order(0), F.concat(
        F.lit('{"job_context":'), F.to_json(_context_dict(F.col("job_context")), _KEEP_NULLS), F.lit(',"primary_signal":'),
        F.when(p.isNull(), F.lit("null")).otherwise(_signal_head(p))).alias("piece"))
    between = analysis.select("job_id", *order(2), F.concat(
        F.when(p.isNull(), F.lit("")).otherwise(_signal_end(p)), F.lit(',"all_signals":[')).alias("piece"))
    sigs = analysis.select("job_id", F.posexplode("all_signals").alias("r", "s"))
    heads = sigs.select("job_id", *order(3, F.col("r")), F.concat(F.when(F.col("r") > 0, F.lit(",")).otherwise(F.lit("")), _signal_head(F.col("s"))).alias("piece"))
    ends = sigs.select("job_id", *order(3, F.col("r"), F.lit(_LAST)), _signal_end(F.col("s")).alias("piece"))
    ranked = sigs.select("job_id", "s.label", "r", "s.first_idx")
    lines = evidence.join(ranked, ["job_id", "label"]).withColumn(
        "piece", F.concat(F.when(F.col("idx") > F.col("first_idx"), F.lit(",")).otherwise(F.lit("")), _json(F.col("line"))))
    # A primary signal's evidence stands in the record twice.
    lines = lines.withColumn("section", F.explode(F.when(F.col("r") == 0, F.array(F.lit(1), F.lit(3))).otherwise(F.array(F.lit(3))))).select(
        "job_id", "section", F.col("r").cast("int").alias("rank"), "idx", "piece")
    end = analysis.select("job_id", *order(4), F.concat(
        F.lit('],"raw_error_snippet":'), _json(F.col("raw_error_snippet")), F.lit(',"timestamp":'), _json(F.col("timestamp")), F.lit("}")).alias("piece"))
    out = head
    for part in (lines, between, heads, ends, end):
        out = out.unionByName(part)
    return out


def write_analysis_records(pieces: DataFrame, out: str, mode: str = "overwrite") -> None:
    """One folder ``job_id=<job>`` a job, whose files, in the order of their names, are its JSON record. Range partitioning on a piece's
    place lets a large record span tasks and files."""
    at = ["job_id", "section", "rank", "idx"]
    (pieces.repartitionByRange(*at).sortWithinPartitions(*at).select("job_id", "piece").write.mode(mode).partitionBy("job_id").text(out))
