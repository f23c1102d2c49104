"""Group-limited per-job line selections: log tail and error subset.

Lines that know how many there are (``n_text``) say themselves whether they are among the last. Else both are
``row_number() <= n`` per job; Spark plans a partial group limit
before the shuffle, so a huge job ships at most ``n`` rows per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.lines import is_error_line


def tail_lines(lines: DataFrame, n: int = R.TAIL_LINES, blank: bool = False) -> DataFrame:
    """The last ``n`` lines of each job as rows (non-blank only unless ``blank``)."""
    pos = "line_no" if blank else "idx"
    if "n_text" in lines.columns and not blank:
        return lines.filter(F.col("idx") > F.col("n_text") - n).select("job_id", F.col("idx").alias("pos"), "value")
    src = lines if blank else lines.filter(F.col("idx").isNotNull())
    w = Window.partitionBy("job_id").orderBy(F.col("pos").desc())
    return (
        src.select("job_id", F.col(pos).alias("pos"), "value")
        .withColumn("_r", F.row_number().over(w))
        .filter(F.col("_r") <= n)
        .drop("_r")
    )


def log_tail(lines: DataFrame, n: int = R.TAIL_LINES, blank: bool = False) -> DataFrame:
    """Last ``n`` lines per job joined with newlines, in log order."""
    return tail_lines(lines, n, blank).groupBy("job_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]),
            "\n",
        ).alias("log_tail")
    )


def error_subset(lines_with_level: DataFrame, n: int = R.ERROR_SUBSET_LINES) -> DataFrame:
    """First ``n`` lines per job that are ERROR/FATAL or labelled.

    Needs ``level`` (see ``with_level_anywhere``) and ``label`` columns.
    """
    w = Window.partitionBy("job_id").orderBy("line_no")
    return (
        lines_with_level.filter(is_error_line(F.col("level"), F.col("label")))
        .withColumn("_r", F.row_number().over(w))
        .filter(F.col("_r") <= n)
        .drop("_r")
    )
