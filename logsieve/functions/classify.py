"""Rule classification as one unrolled CASE.

``CASE WHEN value RLIKE p0 THEN 0 WHEN value RLIKE p1 THEN 1 ... END`` keeps the
first-match-wins order, short-circuits per line and compiles each pattern once
per task. The label, category and severity are then looked up by position in
literal arrays, so the CASE itself is evaluated once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules as R
from .regex import rlike_ci


#: Rules of one CASE.
BLOCK = 500


def classify_prio(value: Column, rules=None, block: int = BLOCK, low: Column | None = None) -> Column:
    """Position (0-based, in priority order) of the first matching rule, or NULL.

    A large table is a chain of CASEs of ``block`` rules; a line goes on to the next only if none before it matched.
    With ``low``, the column of ``lowered`` lines, a rule's pattern only runs on lines that hold a word it needs.
    """
    rl = R.rule_list(rules)
    parts = []
    for lo in range(0, len(rl), block):
        expr = None
        for pos, (_prio, pattern, _cat, _sev, _label) in enumerate(rl[lo:lo + block], lo):
            cond = rlike_ci(value, pattern, low)
            expr = F.when(cond, F.lit(pos)) if expr is None else expr.when(cond, F.lit(pos))
        parts.append(expr)
    return parts[0] if len(parts) == 1 else F.coalesce(*parts, F.lit(None).cast("int"))


def classify_columns(pos: Column, rules=None) -> dict[str, Column]:
    """label, category, severity and sev_rank for a rule position column."""
    rl = R.rule_list(rules)

    def pick(values):
        return F.get(F.array(*[F.lit(v) for v in values]), pos)

    return {
        "label": pick([r[4] for r in rl]),
        "category": pick([r[2] for r in rl]),
        "severity": pick([r[3] for r in rl]),
    }


def severity_rank(severity: Column) -> Column:
    """0 for CRITICAL ... 3 for LOW; one past the last for anything else, so that a
    user rule of an unknown severity never outranks a known one."""
    at = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in R.SEVERITY_ORDER]), severity), F.lit(0))
    return F.when(at == 0, F.lit(len(R.SEVERITY_ORDER))).otherwise(at - 1).cast("bigint")
