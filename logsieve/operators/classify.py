"""Per-line operators over a ``lines`` table (job_id, line_no, idx, value).

``idx`` is NULL on blank lines: blank lines are dropped before parsing and
classification (R2) but still count in ``line_no``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.classify import classify_columns, classify_prio
from ..functions.lines import level_anywhere, parsed_fields
from ..functions.regex import lowered

#: Rules compiled into one CASE.
RULE_BLOCK = 500


def drop_blank(lines: DataFrame) -> DataFrame:
    """Non-blank lines only (R2)."""
    return lines.filter(F.col("idx").isNotNull())


def parse_lines(lines: DataFrame) -> DataFrame:
    """Entries: non-blank lines with ts, level, thread, logger, message."""
    fields = parsed_fields(F.col("value"))
    return drop_blank(lines).withColumns(fields)


def with_level_anywhere(lines: DataFrame) -> DataFrame:
    """Level as the Spark path reads it: first level word anywhere."""
    return lines.withColumn("level", level_anywhere(F.col("value")))


def classify(lines: DataFrame, rules=None) -> DataFrame:
    """Add label, category, severity of the first matching rule.

    Only non-blank lines are classified; no match gives NULLs.
    """
    rl = R.rule_list(rules)  # a rule DataFrame is collected once, here
    pos = F.when(F.col("idx").isNotNull(), classify_prio(F.col("value"), rl, low=F.col("_low")))
    return lines.withColumn("_low", lowered(F.col("value"))).withColumn("_rule", pos).withColumns(
        classify_columns(F.col("_rule"), rl)).drop("_rule", "_low")


def classify_join(lines: DataFrame, rules: DataFrame, block: int = RULE_BLOCK) -> DataFrame:
    """Classification against a rule *table* of any size (R5, table form).

    Rules are taken in blocks by ``prio``; a block is compiled into one CASE of literal patterns (each
    compiled once per task), and a line that no block before matched goes on to the next. Nothing is
    joined, broadcast or shuffled. Only matched lines come back, with label, category, severity.
    """
    out = drop_blank(lines).withColumn("_low", lowered(F.col("value"))).withColumn("_r", F.lit(None).cast("struct<label:string,category:string,severity:string>"))
    for rl in _rule_blocks(rules, block):
        pos = classify_prio(F.col("value"), rl, low=F.col("_low"))
        found = F.get(F.transform(F.array(pos), _rule_struct(rl)), F.lit(0))
        out = out.withColumn("_r", F.coalesce("_r", found))
    return out.where(F.col("_r").isNotNull()).select(
        "job_id", "line_no", "idx", "value", "_r.label", "_r.category", "_r.severity")


def _rule_struct(rl: list):
    def struct(pos):
        return F.when(pos.isNotNull(), F.struct(*[c.alias(k) for k, c in classify_columns(pos, rl).items()]))
    return struct


def _rule_blocks(rules: DataFrame, block: int):
    """Lists of at most ``block`` rules in order of prio; partitions come to the driver one at a time."""
    part: list[tuple] = []
    for r in rules.select("prio", "pattern", "category", "severity", "label").orderBy("prio").toLocalIterator():
        part.append(tuple(r))
        if len(part) == block:
            yield part
            part = []
    if part:
        yield part


def rule_table(spark, rules=None) -> DataFrame:
    return R.rules_df(spark, R.rule_list(rules))
