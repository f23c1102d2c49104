"""Column expressions: regex helpers, line parsing and rule classification."""

from .classify import classify_prio, classify_columns
from .lines import (
    executor_lost, failed_stage, is_error, is_error_line, is_stack_line, is_warn,
    level_anywhere, oom, parsed_fields, platform, shuffle_failure, spark_version, task_retry,
)
from .regex import ci, cs, is_blank, py_strip

__all__ = [
    "classify_prio", "classify_columns", "executor_lost", "failed_stage", "is_error",
    "is_error_line", "is_stack_line", "is_warn", "level_anywhere", "oom", "parsed_fields",
    "platform", "shuffle_failure", "spark_version", "task_retry", "ci", "cs", "is_blank",
    "py_strip",
]
