"""Triage reports (P2) and failure-callback triage (P3) as batch jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..operators import report as RP
from .analyze import analyze, handing_on


def triage_table(analysis: DataFrame, replies: DataFrame | None = None, as_of: str | None = None) -> DataFrame:
    """Triage rows per job with platform and version attached.

    Without ``replies`` the rule-based triage is used (T5); with a replies
    table (job_id, raw, model, tokens) the parsed replies are (T3/T4).
    """
    keep = [F.col("job_context.job_name").alias("job_name"), F.col("job_context.platform").alias("platform"),
            F.col("job_context.spark_version").alias("spark_version")]
    if replies is None:
        return RP.rule_triage(analysis, keep=keep)
    if as_of is None:
        raise ValueError("as_of, the time stamp of the parsed replies, is needed")
    parsed = RP.parse_response(replies, as_of=as_of).drop("parsed")
    ctx = analysis.select("job_id", *keep)
    return parsed.join(ctx, "job_id", "left")


def triage_report(lines: DataFrame, rules=None, *, as_of: str,
                  recipients: str | None = None, severities=None, replies: DataFrame | None = None,
                  only_failed: bool = False, footer: str = RP.DEFAULT_FOOTER,
                  evidence_cap: int | None = R.EVIDENCE_CAP, **how) -> DataFrame:
    """Flagship (P2): analyse every job, triage, gate by severity, render the
    alert texts and fan out to recipients. One row per (job, recipient):
    job_id, recipient, severity, subject, body. The texts need few evidence lines, so only so many are kept;
    ``how`` goes on to ``analyze``.
    """
    a = analyze(lines, rules, as_of=as_of, evidence_cap=evidence_cap, **how)
    kept = a.filter(F.col("primary_signal").isNotNull()) if only_failed else a
    tri = triage_table(kept, replies, as_of)
    gated = RP.alert_gate(tri, severities)
    alerts = RP.alert_text(gated, footer)
    return handing_on(RP.alert_outbox(alerts, recipients or R.DEFAULT_RECIPIENTS).select(
        "job_id", "recipient", "severity", "subject", "body"), a)
