"""Failure triage from a real task-log folder."""

import os
import tempfile

from pyspark.sql import functions as F

from logsieve.plans.failures import triage_failures, triage_failures_in_folder
from logsieve.sources.airflow import TI_TYPE, DAG_RUN_TYPE

FAIL = "24/01/01 00:00:00 ERROR Executor: java.lang.OutOfMemoryError: Java heap space\n"


def failures(spark, rows):
    df = spark.createDataFrame(rows, "failure_id string, dag string, task string, date string, try int, exception string")
    ti = F.struct(F.col("dag").alias("dag_id"), F.col("task").alias("task_id"), F.col("date").alias("execution_date"), F.col("try").alias("try_number"),
                  F.lit("Op").alias("operator"), F.lit("h").alias("hostname"), F.lit("u").alias("log_url")).cast(TI_TYPE)
    run = F.struct(F.col("dag").alias("dag_id"), F.lit("r").alias("run_id"), F.col("date").alias("execution_date")).cast(DAG_RUN_TYPE)
    return df.select("failure_id", ti.alias("task_instance"), F.lit(None).cast(TI_TYPE).alias("ti"), run.alias("dag_run"), "exception")


def test_folder_equals_table(spark):
    base = tempfile.mkdtemp(prefix="task logs-")
    texts = {"dag a/t/2024-01-01 00:00/1.log": FAIL * 3, "dag[b]/t/2024-01-01/1.log": "INFO x\n" * 300_000 + "24/01/01 00:00:00 FATAL DiskStore: No space left on device\n",
             "dag_c/t/2024-01-01/1.log": ""}
    table = []
    for name, text in texts.items():
        path = os.path.join(base, name.replace(" 00:00", "_00_00"))
        os.makedirs(os.path.dirname(path))
        with open(path, "w") as f:
            f.write(text)
        table.append((path, text))
    rows = [("1", "dag a", "t", "2024-01-01 00:00", 1, ""), ("2", "dag[b]", "t", "2024-01-01", 1, ""), ("3", "dag_c", "t", "2024-01-01", 1, "java.lang.OutOfMemoryError"),
            ("4", "none", "t", "2024-01-01", 1, ""), ("5", "none", "t", "2024-01-01", 2, "x FetchFailed")]
    f = failures(spark, rows)
    cols = ["job_id", "job_name", "category", "severity", "failure_signature", "alert"]
    got = sorted(map(tuple, triage_failures_in_folder(spark, f, base, "T").select(*cols).collect()))
    want = sorted(map(tuple, triage_failures(f, spark.createDataFrame(table, "path string, text string"), base, "T").select(*cols).collect()))
    assert got == want and len(got) == 5
    assert "No space left" in got[1][4] and "OutOfMemoryError" in got[0][4]
