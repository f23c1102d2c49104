"""logsieve: corpus-scale triage of failed Spark job logs on Spark.

Logs become a ``lines`` table (job_id, line_no, idx, value); every step after
that - parsing, rule classification, per-job context, ranked failure signals,
stack traces, tails, reports, prompts, reply parsing and the alert outbox - is
a DataFrame job (built-in functions, windows, joins, Structured Streaming).
"""

from .plans.analyze import analyze, flat_analysis, release
from .plans.failures import triage_failures, triage_failures_in_folder
from .plans.triage import triage_report
from .streaming.rescan import rescan_to_outbox
from .streaming.watch import watch_logs
from .rules import DEFAULT_RULES, rules_df
from .session import get_session
from .sources.text import lines_from_text

__all__ = ["analyze", "flat_analysis", "release", "triage_report", "triage_failures", "triage_failures_in_folder",
           "watch_logs", "rescan_to_outbox",
           "DEFAULT_RULES", "rules_df", "get_session", "lines_from_text"]
