"""Independent DuckDB statements of each query, for cross-checking results.

They restate the semantics in plain SQL (full windows, string_agg, RE2) over
the same parquet tables; they share nothing with the Spark plans except the
fixed rule patterns and templates. Tables are DuckDB views named after the
parquet files (events, documents, ...).
"""

from __future__ import annotations

from .. import rules as R
from .corpus import BLOCK_TEMPLATES, OTHER_TEMPLATE


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def _template_case() -> str:
    whens = " ".join(f"WHEN {i} THEN {q(t)}" for i, t in enumerate(BLOCK_TEMPLATES))
    return f"CASE event_id % 24 {whens} ELSE {q(OTHER_TEMPLATE)} END"


def _rule_case(col: str = "value", rules=R.DEFAULT_RULES) -> str:
    whens = " ".join(
        f"WHEN regexp_matches({col}, {q(p)}, 'i') THEN {i}" for i, (_, p, _, _, _) in enumerate(rules)
    )
    return f"CASE {whens} END"


def _arr(vals) -> str:
    return "[" + ", ".join(q(v) for v in vals) + "]"


SEV_RANKS = " ".join(f"WHEN {q(s)} THEN {i}" for i, s in enumerate(R.SEVERITY_ORDER))
STRIP = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
NONBLANK = "regexp_matches({c}, '\\S')"


def strip(c: str) -> str:
    return STRIP.format(c=c)


def nonblank(c: str) -> str:
    return NONBLANK.format(c=c)


def corpus_ctes() -> str:
    """CTEs: raw_lines (job_id, line_no, value) and lines (+ idx) from events."""
    return f"""
blocks AS (
  SELECT 'job_' || CAST(user_id AS VARCHAR) AS job_id, ts, event_id,
         replace(replace({_template_case()}, '@', strftime(ts, '%y/%m/%d %H:%M:%S')),
                 '#', CAST(event_id % 7 AS VARCHAR)) AS block
  FROM events),
exploded AS (
  SELECT job_id, ts, event_id, UNNEST(string_split(block, chr(10))) AS value,
         UNNEST(range(len(string_split(block, chr(10))))) AS pos
  FROM blocks),
raw_lines AS (
  SELECT job_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id, pos) AS BIGINT) AS line_no, value
  FROM exploded),
lines AS (
  SELECT job_id, line_no, value,
         CASE WHEN {nonblank('value')} THEN CAST(
           sum(CASE WHEN {nonblank('value')} THEN 1 ELSE 0 END)
             OVER (PARTITION BY job_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
           AS BIGINT) END AS idx
  FROM raw_lines)"""


def analysis_ctes(rules=R.DEFAULT_RULES) -> str:
    """CTEs over ``lines``: classified, hits, sig, ev, stacks, ranked, ctx, stages, tail, snippet.

    ``ev`` has the first lines as ``evidence`` and every line as ``evidence_list``."""
    labels, categories, severities = (_arr([r[k] for r in rules]) for k in (4, 2, 3))
    sp = R.STACK_FRAME_PATTERN
    vp = R.SPARK_VERSION_PATTERN
    pp = R.PLATFORM_PATTERN
    return f"""
classified AS (
  SELECT *, CASE WHEN idx IS NOT NULL THEN {_rule_case("value", rules)} END AS rule_pos FROM lines),
labelled AS (
  SELECT job_id, line_no, idx, value,
         {labels}[rule_pos + 1] AS label, {categories}[rule_pos + 1] AS category,
         {severities}[rule_pos + 1] AS severity
  FROM classified),
hits AS (SELECT * FROM labelled WHERE label IS NOT NULL),
sig AS (
  SELECT job_id, label, arg_min(category, idx) AS category, arg_min(severity, idx) AS severity,
         count(*) AS n, min(idx) AS first_idx
  FROM hits GROUP BY job_id, label),
ev_ranked AS (
  SELECT job_id, label, idx, {strip('value')} AS line,
         row_number() OVER (PARTITION BY job_id, label ORDER BY idx) AS rank
  FROM hits),
ev AS (
  SELECT job_id, label, string_agg(CASE WHEN rank <= {R.EVIDENCE_CAP} THEN line END, chr(10) ORDER BY rank) AS evidence,
         string_agg(CASE WHEN rank <= {R.SNIPPET_EVIDENCE} THEN line END, chr(10) ORDER BY rank) AS evidence2,
         arg_min(line, rank) AS evidence1, list(line ORDER BY rank) AS evidence_list
  FROM ev_ranked GROUP BY job_id, label),
probes AS (
  SELECT job_id, label, UNNEST(range(first_idx + 1, first_idx + {R.STACK_WINDOW} + 1)) AS p FROM sig),
stack_lines AS (
  SELECT job_id, idx AS p, {strip('value')} AS frame FROM lines
  WHERE idx IS NOT NULL AND (regexp_matches(value, {q(sp)}) OR contains(value, 'Caused by:'))),
runs AS (
  SELECT pr.job_id, pr.label, pr.p, s.frame,
         pr.p - row_number() OVER (PARTITION BY pr.job_id, pr.label ORDER BY pr.p) AS grp
  FROM probes pr JOIN stack_lines s ON pr.job_id = s.job_id AND pr.p = s.p),
stacks AS (
  SELECT job_id, label, string_agg(frame, chr(10) ORDER BY p) AS stack_trace
  FROM (SELECT *, min(grp) OVER (PARTITION BY job_id, label) AS g0 FROM runs) WHERE grp = g0
  GROUP BY job_id, label),
signals AS (
  SELECT s.job_id, s.label, s.category, s.severity,
         CAST(CASE s.severity {SEV_RANKS} ELSE {len(R.SEVERITY_ORDER)} END AS BIGINT) AS sev_rank, s.n, s.first_idx,
         e.evidence, e.evidence2, e.evidence1, e.evidence_list, st.stack_trace
  FROM sig s LEFT JOIN ev e USING (job_id, label) LEFT JOIN stacks st USING (job_id, label)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY sev_rank, first_idx) AS signal_rank FROM signals),
stages AS (
  SELECT job_id, string_agg(stage, ',' ORDER BY first_line) AS failed_stages,
         list(stage ORDER BY first_line) AS stage_list FROM (
    SELECT job_id, stage, min(line_no) AS first_line FROM (
      SELECT job_id, line_no, regexp_extract(value, {q('(?i)' + R.STAGE_FAIL_PATTERN)}, 1) AS stage FROM lines)
    WHERE stage <> '' GROUP BY job_id, stage)
  GROUP BY job_id),
ctx_lines AS (
  SELECT job_id, line_no, idx, value,
         coalesce(nullif(regexp_extract(value, {q('(?i)' + vp)}, 1), ''),
                  nullif(regexp_extract(value, {q('(?i)' + vp)}, 2), ''),
                  nullif(regexp_extract(value, {q('(?i)' + vp)}, 3), '')) AS version,
         nullif(lower(regexp_extract(value, {q('(?i)' + pp)}, 1)), '') AS platform
  FROM lines),
ctx0 AS (
  SELECT job_id,
         coalesce(arg_min(platform, line_no) FILTER (WHERE platform IS NOT NULL), 'unknown') AS platform,
         coalesce(arg_min(version, line_no) FILTER (WHERE version IS NOT NULL), 'unknown') AS spark_version,
         count(idx) AS total_log_lines,
         count(*) FILTER (WHERE contains(value, 'ERROR')) AS error_count,
         count(*) FILTER (WHERE contains(value, 'WARN')) AS warn_count,
         count(*) FILTER (WHERE regexp_matches(value, {q(R.EXECUTOR_LOST_PATTERN)}, 'i')) AS executors_lost,
         count(*) FILTER (WHERE regexp_matches(value, {q(R.OOM_PATTERN)}, 'i')) AS oom_events,
         count(*) FILTER (WHERE regexp_matches(value, {q(R.SHUFFLE_FAIL_PATTERN)}, 'i')) AS shuffle_failures,
         count(*) FILTER (WHERE regexp_matches(value, {q(R.TASK_RETRY_PATTERN)}, 'i')) AS task_retries
  FROM ctx_lines GROUP BY job_id),
ctx AS (
  SELECT c.*, coalesce(s.failed_stages, '') AS failed_stages,
         coalesce(s.stage_list, CAST([] AS VARCHAR[])) AS stage_list
  FROM ctx0 c LEFT JOIN stages s USING (job_id)),
tail AS (
  SELECT job_id, string_agg(value, chr(10) ORDER BY idx) AS log_tail FROM (
    SELECT job_id, idx, value, row_number() OVER (PARTITION BY job_id ORDER BY idx DESC) AS r
    FROM lines WHERE idx IS NOT NULL) WHERE r <= {R.TAIL_LINES} GROUP BY job_id),
snippet AS (
  SELECT job_id, string_agg(part, chr(10) ORDER BY signal_rank) AS raw_error_snippet FROM (
    SELECT job_id, signal_rank,
           concat_ws(chr(10), evidence2,
                     CASE WHEN length(stack_trace) > 0 THEN left(stack_trace, {R.SNIPPET_STACK_CHARS}) END) AS part
    FROM ranked WHERE signal_rank <= {R.SNIPPET_SIGNALS}) GROUP BY job_id),
primary_sig AS (SELECT * FROM ranked WHERE signal_rank = 1),
summary AS (
  SELECT job_id, count(*) AS n_signals,
         string_agg(label || 'x' || CAST(n AS VARCHAR), ',' ORDER BY signal_rank) AS signal_list,
         string_agg('  [' || severity || '] ' || label || ' (' || category || '): ' || CAST(n AS VARCHAR)
                    || ' occurrence(s)', chr(10) ORDER BY signal_rank) AS signal_lines,
         list({{'category': category, 'pattern_matched': label, 'severity': severity,
                'evidence_lines': evidence_list, 'stack_trace': stack_trace}}
              ORDER BY signal_rank) AS signal_dicts
  FROM ranked GROUP BY job_id),
analysis AS (
  SELECT c.job_id, c.platform, c.spark_version, c.total_log_lines, c.error_count, c.warn_count,
         c.executors_lost, c.oom_events, c.shuffle_failures, c.task_retries, c.failed_stages,
         p.label AS primary_label, p.category AS primary_category, p.severity AS primary_severity,
         coalesce(sm.n_signals, 0) AS n_signals, coalesce(sm.signal_list, '') AS signal_list,
         coalesce(sn.raw_error_snippet, '') AS raw_error_snippet, coalesce(t.log_tail, '') AS log_tail,
         p.evidence1 AS primary_evidence1, p.stack_trace AS primary_stack, p.evidence AS primary_evidence,
         sm.signal_lines, sm.signal_dicts, c.stage_list,
         CASE WHEN p.label IS NOT NULL THEN {{'category': p.category, 'pattern_matched': p.label,
           'severity': p.severity, 'evidence_lines': p.evidence_list, 'stack_trace': p.stack_trace}} END AS primary_dict
  FROM ctx c LEFT JOIN primary_sig p USING (job_id) LEFT JOIN summary sm USING (job_id)
  LEFT JOIN snippet sn USING (job_id) LEFT JOIN tail t USING (job_id))"""


def with_corpus(body: str, extra_ctes: str = "", rules=R.DEFAULT_RULES) -> str:
    """A statement over the rendered corpus with all analysis CTEs available."""
    ctes = corpus_ctes() + "," + analysis_ctes(rules)
    if extra_ctes:
        ctes += "," + extra_ctes
    return f"WITH {ctes}\n{body}"


def text_lines_sql(table: str, key: str, text: str) -> str:
    """CTE body: ``str.splitlines`` of a text column, numbered, with idx."""
    brk = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
    end = r"[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]$"
    return f"""
tl_parts AS (
  SELECT CAST({key} AS VARCHAR) AS job_id,
         CASE WHEN {text} = '' THEN []
              ELSE list_slice(string_split_regex({text}, {q(brk)}), 1,
                              len(string_split_regex({text}, {q(brk)}))
                              - CASE WHEN regexp_matches({text}, {q(end)}) THEN 1 ELSE 0 END) END AS parts
  FROM {table}),
tl_raw AS (
  SELECT job_id, UNNEST(parts) AS value, UNNEST(range(1, len(parts) + 1)) AS line_no FROM tl_parts),
text_lines AS (
  SELECT job_id, CAST(line_no AS BIGINT) AS line_no, value,
         CASE WHEN {nonblank('value')} THEN CAST(
           sum(CASE WHEN {nonblank('value')} THEN 1 ELSE 0 END)
             OVER (PARTITION BY job_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
           AS BIGINT) END AS idx
  FROM tl_raw)"""
