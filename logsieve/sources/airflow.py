"""Failure contexts of scheduler tasks and their logs.

A failure context is a row: task_instance / ti (structs with dag_id, task_id,
execution_date, try_number, operator, hostname, log_url), dag_run (dag_id,
run_id, execution_date) and exception text. Normalising, locating the log and
choosing the log text are joins and coalesce chains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TI_TYPE = T.StructType([
    T.StructField("dag_id", T.StringType()), T.StructField("task_id", T.StringType()),
    T.StructField("execution_date", T.StringType()), T.StructField("try_number", T.IntegerType()),
    T.StructField("operator", T.StringType()), T.StructField("hostname", T.StringType()),
    T.StructField("log_url", T.StringType()),
])
DAG_RUN_TYPE = T.StructType([
    T.StructField("dag_id", T.StringType()), T.StructField("run_id", T.StringType()),
    T.StructField("execution_date", T.StringType()),
])
CONTEXT_COLUMNS = ["dag_id", "task_id", "run_id", "execution_date", "try_number", "operator",
                   "hostname", "log_url", "exception"]

# FIXED VALUES: log text used when no log file can be read.
NO_LOG_WITH_EXCEPTION = "Airflow task failure — no log file found.\nDAG: {dag} | Task: {task} | Run: {run}\nException:\n{exc}"
NO_LOG = "Airflow task {dag}.{task} failed. No log available."
DATE_SUFFIX = "T000000.000000+0000"


def failure_context(failures: DataFrame, as_of: str, keep: list[str] | None = None) -> DataFrame:
    """Normalised context per failure.

    ti = task_instance, else ti. dag_id from ti (if non-empty), else dag_run,
    else 'unknown'; execution_date from ti, else dag_run, else ``as_of``;
    run_id 'manual', try 1, operator and hostname 'unknown', log_url '' when
    missing; exception '' when missing.
    """
    ti = F.coalesce(F.col("task_instance"), F.col("ti"))
    dr = F.col("dag_run")
    return failures.select(
        *(keep or []),
        F.coalesce(F.nullif(ti["dag_id"], F.lit("")), dr["dag_id"], F.lit("unknown")).alias("dag_id"),
        F.coalesce(ti["task_id"], F.lit("unknown")).alias("task_id"),
        F.coalesce(dr["run_id"], F.lit("manual")).alias("run_id"),
        F.coalesce(F.nullif(ti["execution_date"], F.lit("")), F.nullif(dr["execution_date"], F.lit("")),
                   F.lit(as_of)).alias("execution_date"),
        F.coalesce(ti["try_number"], F.lit(1)).cast("int").alias("try_number"),
        F.coalesce(ti["operator"], F.lit("unknown")).alias("operator"),
        F.coalesce(ti["hostname"], F.lit("unknown")).alias("hostname"),
        F.coalesce(ti["log_url"], F.lit("")).alias("log_url"),
        F.coalesce(F.col("exception"), F.lit("")).alias("exception"),
    )


def candidate_paths(base: str, try_number: F.Column | None = None) -> F.Column:
    """The two places a task log may be, in order."""
    safe = F.regexp_replace(F.col("execution_date"), r"(?U)[:\s]", "_")
    tn = F.col("try_number") if try_number is None else try_number
    tail = F.concat(tn.cast("string"), F.lit(".log"))

    def path(date):
        return F.concat_ws("/", F.lit(base.rstrip("/")), F.col("dag_id"), F.col("task_id"), date, tail)

    return F.array(
        F.struct(F.lit(1).alias("prio"), path(safe).alias("path")),
        F.struct(F.lit(2).alias("prio"), path(F.concat(safe, F.lit(DATE_SUFFIX))).alias("path")),
    )


def locate_logs(contexts: DataFrame, listing: DataFrame, base: str, key: str = "failure_id") -> DataFrame:
    """Add ``log_path``: the first candidate that exists in ``listing`` (path
    column), else NULL (S7). Candidates are exploded and equi-joined with the
    listing; the best per failure is ``min_by(path, prio)``."""
    cands = contexts.select(key, F.explode(candidate_paths(base)).alias("c")).select(
        key, "c.prio", "c.path")
    found = (
        cands.join(listing.select("path").distinct(), "path", "inner")
        .groupBy(key).agg(F.min_by("path", "prio").alias("log_path"))
    )
    return contexts.join(found, key, "left")


def resolve_log_text(located: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``log_text`` (S9): the file text when found and non-empty, else a
    fixed text with the exception, else a 'No log available' line.
    ``files`` is (path, text)."""
    f = files.select(F.col("path").alias("log_path"), F.col("text").alias("_text"))
    # Failures without a log share the key NULL: they pass by the join, which would put them in one task.
    j = located.where(F.col("log_path").isNotNull()).join(f, "log_path", "left").unionByName(
        located.where(F.col("log_path").isNull()).withColumn("_text", F.lit(None).cast("string")))
    with_exc = F.format_string(
        NO_LOG_WITH_EXCEPTION.replace("{dag}", "%1$s").replace("{task}", "%2$s")
        .replace("{run}", "%3$s").replace("{exc}", "%4$s"),
        F.col("dag_id"), F.col("task_id"), F.col("run_id"), F.col("exception"))
    no_log = F.format_string(NO_LOG.replace("{dag}", "%1$s").replace("{task}", "%2$s"),
                             F.col("dag_id"), F.col("task_id"))
    text = F.coalesce(
        F.nullif(F.col("_text"), F.lit("")),
        F.when(F.col("exception") != "", with_exc),
        no_log,
    )
    return j.withColumn("log_text", text).drop("_text")
