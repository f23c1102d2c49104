"""Plan properties that the design relies on at scale, checked on executed plans."""

import os
import re

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="test tables not present")
STREAMING = {"watch_logs", "watch_changes", "stream_signal_counts", "read_logs", "read_logs_cut", "rescan_logs", "rescan_alerts"}


def _plan(spark, name):
    df = E.queries()[name](spark, SF)
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(E._QUERIES) - STREAMING))
def test_no_python_no_cartesian_no_nested_loop(spark, name):
    p = _plan(spark, name)
    for op in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "CartesianProduct", "FlatMapGroupsInPandas"):
        assert op not in p, f"{name} plans {op}"
    assert "BroadcastNestedLoopJoin" not in p, name


def test_level_stats_needs_no_numbers(spark):
    p = _plan(spark, "level_stats")
    assert p.count("FileScan parquet") == 1 and "Window" not in p


def test_corpus_scan_is_pruned(spark):
    p = _plan(spark, "number_lines")
    schemas = set(re.findall(r"ReadSchema: (struct<[^>]*>)", p))
    assert schemas == {"struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>"}


def test_failure_filter_reaches_the_scan(spark):
    p = _plan(spark, "failure_context")
    assert "EqualTo(event_type,error)" in p


def test_group_limits_are_map_side(spark):
    for name in ("top_evidence", "error_subset"):
        p = _plan(spark, name)
        assert "WindowGroupLimit" in p, name


def test_tail_needs_no_sort_where_lines_know_their_total(spark):
    from logsieve.operators.tail import log_tail
    lines = E._lines(spark, SF)
    with_total, without = log_tail(lines), log_tail(lines.drop("n_text"))
    assert sorted(map(tuple, with_total.collect())) == sorted(map(tuple, without.collect()))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan(without) and "WindowGroupLimit" not in plan(with_total)


def test_analysis_keeps_no_plain_line_and_reads_once(spark):
    from logsieve.plans.analyze import annotate, telling_lines
    lines = E._lines(spark, SF)
    telling = telling_lines(annotate(lines), tail_lines=2)
    rows = {(r.job_id, r.line_no): r for r in telling.collect()}
    dropped = plain = 0
    for r in annotate(lines).collect():
        quoted = r.label is not None or r._stack or (r.idx or 0) > r.n_text - 2
        kept = rows.get((r.job_id, r.line_no))
        assert (kept is not None and kept.value == r.value) if quoted else kept is None or kept.value is None
        dropped, plain = dropped + (kept is None), plain + (kept is not None and kept.value is None)
    assert dropped and plain
    p = telling._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    assert p.count("OutOfMemoryError|GC overhead limit exceeded") == 1  # each rule runs once a line

