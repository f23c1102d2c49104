"""Patterns only run on lines that hold a word they need; what matches doesn't change by it."""

import pytest
from pyspark.sql import functions as F

from logsieve import rules as R
from logsieve.functions.regex import first_group, lowered, needed_words, rlike_ci
from logsieve.operators.classify import classify, classify_join, rule_table

PATTERNS = [*(r[1] for r in R.DEFAULT_RULES), R.SPARK_VERSION_PATTERN, R.PLATFORM_PATTERN, R.STAGE_FAIL_PATTERN, R.EXECUTOR_LOST_PATTERN, R.OOM_PATTERN,
            R.SHUFFLE_FAIL_PATTERN, R.TASK_RETRY_PATTERN, "licen[cs]e|copyright", "ab?c", "a+b", "[^a]bc", "", "ab||c", r"a\.?b", "colou?r", "(?:ski|t)s", "\\bks\\b", "sıx"]
LINES = ["", " ", None, "Executor 3 LOST", "executor loſt", "Kryo x Exception", "K8s", "K8S", "taſk retry", "TASK x RETRY", "dİskspaceexception", "GC OVERHEAD", "abc",
         "ac", "aab", "xbc", "a.b", "COLOR", "licenſe", "License", "ks", "Ks", "SıX", "six", "Stage 12 Aborted", "Lost executor 7", "403 Forbidden", "ADLS é ERROR", "� denied accessdenied"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_a_guarded_pattern_matches_the_same(spark, pattern):
    rows = spark.createDataFrame([(x,) for x in LINES], "v string").withColumn("low", lowered(F.col("v")))
    v, low = F.col("v"), F.col("low")
    got = rows.select(rlike_ci(v, pattern).alias("a"), rlike_ci(v, pattern, low).alias("b"), first_group(v, pattern, 0).alias("c"),
                      first_group(v, pattern, 0, low=low).alias("d")).collect()
    assert [(r.a, r.c) for r in got] == [(r.b, r.d) for r in got]


def test_words_that_a_pattern_needs():
    assert all(needed_words(r[1]) for r in R.DEFAULT_RULES)
    assert needed_words("Task.*failed.*attempt|Stage.*failed|Job aborted") == ["attempt", "failed", "job aborted"] or \
        needed_words("Task.*failed.*attempt|Stage.*failed|Job aborted") == ["failed", "job aborted"]
    assert needed_words(r"Stage\s+(\d+)\s+(?:failed|aborted)") == ["stage"] and needed_words("licen[cs]e|copyright") == ["copyright", "licen"]
    for unread in ("", "ab||c", "x*", "ab{2}c", "a\\x41bc", "ab(?=d)", "(?i)abc", "(ab(cd)ef)gh", "é+abc"):
        assert needed_words(unread) is None


def test_rules_are_guarded(spark):
    lines = spark.createDataFrame([("a", 1, 1, "x Executor 1 lost"), ("a", 2, 2, "executor loſt"), ("a", 3, None, " "), ("a", 4, 3, "none")],
                                  "job_id string, line_no long, idx long, value string")
    want = [(1, "ExecutorLost"), (2, "ExecutorLost")]
    assert sorted((r.line_no, r.label) for r in classify(lines).where("label IS NOT NULL").collect()) == want
    joined = classify_join(lines, rule_table(spark), block=4)
    assert sorted((r.line_no, r.label) for r in joined.collect()) == want
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lower(") < 5 and "Contains" in plan  # computed in one place
