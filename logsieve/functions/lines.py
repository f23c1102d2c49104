"""Per-line column expressions (R2-R13): parsing, levels, context flags.

All of them are built-in expressions, so they stay inside whole-stage codegen;
none needs a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules as R
from .regex import cs, first_group, rlike_ci

_LINE = cs(R.LOG_LINE_PATTERN)


def parsed_fields(value: Column) -> dict[str, Column]:
    """timestamp?, level?, [thread]?, logger?, message of one line.

    Level defaults to INFO, logger to '', timestamp and thread to NULL. A line
    the layout does not match keeps the whole line as its message.
    """
    g = lambda i: F.regexp_extract(value, _LINE, i)
    return {
        "ts": F.nullif(g(1), F.lit("")),
        "level": F.coalesce(F.nullif(g(2), F.lit("")), F.lit("INFO")),
        "thread": F.nullif(g(3), F.lit("")),
        "logger": g(4),
        "message": F.coalesce(F.nullif(g(5), F.lit("")), value),
    }


def level_anywhere(value: Column) -> Column:
    """First whole word ERROR/WARN/INFO/DEBUG/FATAL anywhere, else INFO."""
    return F.coalesce(
        F.nullif(F.regexp_extract(value, cs(R.LEVEL_ANYWHERE_PATTERN), 1), F.lit("")),
        F.lit("INFO"),
    )


def is_stack_line(value: Column) -> Column:
    """A JVM frame ``<ws>at a.b(`` or a ``Caused by:`` line."""
    return value.rlike(cs(R.STACK_FRAME_PATTERN)) | value.contains(R.CAUSED_BY)


def is_error(value: Column) -> Column:
    """Line contains ERROR (substring, case-sensitive)."""
    return value.contains("ERROR")


def is_warn(value: Column) -> Column:
    return value.contains("WARN")


def spark_version(value: Column, low: Column | None = None) -> Column:
    """Version from the first match of the three forms, or NULL.

    Every form contains the word 'spark', so the three extractions only run
    on lines where a case-insensitive search for it succeeds."""
    p = R.SPARK_VERSION_PATTERN
    return F.when(rlike_ci(value, "spark", low), F.coalesce(*[first_group(value, p, k) for k in (1, 2, 3)]))


def platform(value: Column, low: Column | None = None) -> Column:
    """First platform word, lower-cased, or NULL (R9). Substring match."""
    return F.lower(first_group(value, R.PLATFORM_PATTERN, 1, low=low))


def failed_stage(value: Column, low: Column | None = None) -> Column:
    """Stage id of the first ``Stage <n> failed|aborted`` on the line."""
    return first_group(value, R.STAGE_FAIL_PATTERN, 1, low=low)


def executor_lost(value: Column, low: Column | None = None) -> Column:
    return rlike_ci(value, R.EXECUTOR_LOST_PATTERN, low)


def oom(value: Column, low: Column | None = None) -> Column:
    return rlike_ci(value, R.OOM_PATTERN, low)


def shuffle_failure(value: Column, low: Column | None = None) -> Column:
    return rlike_ci(value, R.SHUFFLE_FAIL_PATTERN, low)


def task_retry(value: Column, low: Column | None = None) -> Column:
    return rlike_ci(value, R.TASK_RETRY_PATTERN, low)


def is_error_line(level: Column, label: Column) -> Column:
    """Line kept for triage on the Spark path: ERROR/FATAL or labelled."""
    return level.isin("ERROR", "FATAL") | label.isNotNull()
