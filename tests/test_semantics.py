"""Line-level semantics against Python's own string functions and edge cases."""

import json
from pathlib import PurePosixPath

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logsieve import rules as R
from logsieve.functions.lines import is_stack_line, parsed_fields, platform
from logsieve.functions.regex import py_strip
from logsieve.operators import report as RP
from logsieve.sources.airflow import failure_context, locate_logs, resolve_log_text
from logsieve.sources.files import file_stem, tail_bytes
from logsieve.plans.analyze import analyze
from logsieve.plans.triage import triage_report
from logsieve.sources.text import lines_from_text, split_lines

EDGE = [
    ("24/03/02 08:14:01 INFO SparkContext: Running", ("24/03/02 08:14:01", "INFO", None, "SparkContext", "Running")),
    ("2024-03-02T08:14:01.5Z ERROR [main] a.B: x", ("2024-03-02T08:14:01.5Z", "ERROR", "main", "a.B", "x")),
    ("2024-03-02 08:14:01,123 ERROR a.B: x", ("2024-03-02 08:14:01", "INFO", None, "", ",123 ERROR a.B: x")),
    ("INFORMATION: x", (None, "INFO", None, "RMATION", "x")),
    ("foo", (None, "INFO", None, "fo", "o")),
    ("\tat a.b.C(D.java:1)", (None, "INFO", None, "at", "a.b.C(D.java:1)")),
]


def test_parse_edge_cases(spark):
    df = spark.createDataFrame([(x,) for x, _ in EDGE], ["value"])
    f = parsed_fields(F.col("value"))
    rows = df.select("value", *[f[k].alias(k) for k in ("ts", "level", "thread", "logger", "message")]).collect()
    got = {r["value"]: (r["ts"], r["level"], r["thread"], r["logger"], r["message"]) for r in rows}
    for x, exp in EDGE:
        assert got[x] == exp, x


def test_stack_lines_and_platform(spark):
    cases = [("\tat a.b.C(D.java:1)", True), ("\tat java.base/java.lang.Thread.run(T.java:1)", False),
             ("\t... 12 more", False), ("Caused by: x", True)]
    df = spark.createDataFrame([(v,) for v, _ in cases], ["value"])
    got = {r.value: r.s for r in df.select("value", is_stack_line(F.col("value")).alias("s")).collect()}
    assert got == dict(cases)
    p = spark.createDataFrame([("memory leaks found",)], ["v"]).select(platform(F.col("v"))).first()[0]
    assert p == "aks"


texts = st.text(alphabet=st.sampled_from(list("ab \t\n\r\x0b\x0c\x1c\x85 é")), max_size=30)


@settings(max_examples=30, deadline=None)
@given(st.lists(texts, min_size=1, max_size=8))
def test_splitlines_and_strip_match_python(spark, xs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "id long, t string")
    rows = df.select("id", split_lines(F.col("t")).alias("p"), py_strip(F.col("t")).alias("s")).collect()
    for r in rows:
        assert list(r.p) == xs[r.id].splitlines()
        assert r.s == xs[r.id].strip()


@settings(max_examples=20, deadline=None)
@given(st.lists(texts, min_size=1, max_size=5))
def test_lines_from_text_numbering(spark, xs):
    df = spark.createDataFrame([(str(i), x) for i, x in enumerate(xs)], "job_id string, text string")
    got = sorted((r.job_id, r.line_no, r.idx, r.value) for r in lines_from_text(df).collect())
    exp = []
    for i, x in enumerate(xs):
        k = 0
        for n, line in enumerate(x.splitlines(), 1):
            if line.strip():
                k += 1
                exp.append((str(i), n, k, line))
            else:
                exp.append((str(i), n, None, line))
    assert got == sorted(exp, key=lambda t: (t[0], t[1], t[2] or 0, t[3]))


def test_file_stem_and_tail_bytes(spark):
    paths = ["/a/b/c.log", "/a/.bashrc", "/a/x.tar.gz", "/a/b.", "plain"]
    df = spark.createDataFrame([(p,) for p in paths], ["p"])
    got = {r.p: r.s for r in df.select("p", file_stem(F.col("p")).alias("s")).collect()}
    assert got == {p: PurePosixPath(p).stem for p in paths}
    t = "héllo wörld " * 5
    r = spark.createDataFrame([(t,)], ["t"]).select(tail_bytes(F.col("t"), 21).alias("x")).first().x
    assert r == t.encode()[-21:].decode("utf-8", errors="replace")


def _triage(spark, raws):
    df = spark.createDataFrame([(str(i), r, "m", 7) for i, r in enumerate(raws)], "job_id string, raw string, model string, tokens long")
    p = RP.parse_response(df, as_of="T").withColumn("cfg_keys", F.map_keys("spark_config_recommendations"))
    return {r.job_id: r for r in p.collect()}


def test_parse_response_cases(spark):
    obj = {"category": "Infra", "confidence": "High", "severity": "CRITICAL", "failure_signature": "sig",
           "root_cause": "rc", "immediate_mitigation": ["a"], "permanent_fix": ["b"], "verify_steps": [],
           "spark_config_recommendations": {"k": "v", "a": "b"}, "incident_notes": {"impact": "x"}}
    raws = [json.dumps(obj), "```json\n" + json.dumps(obj) + "\n```", "Sure! " + json.dumps(obj) + " bye",
            "no json at all", "[1, 2]", "", '{"severity": null}']
    t = _triage(spark, raws)
    for i in ("0", "1", "2"):
        assert t[i].parsed and t[i].category == "Infra" and t[i].severity == "CRITICAL"
        assert list(t[i].cfg_keys) == ["k", "a"]
        assert t[i].spark_config_recommendations == {"k": "v", "a": "b"}
    assert not t["3"].parsed and t["3"].confidence == "Low" and t["3"].failure_signature == "no json at all"
    assert not t["4"].parsed
    assert not t["5"].parsed and t["5"].failure_signature == ""
    assert t["6"].parsed and t["6"].severity is None and t["6"].category == "Spark"
    assert t["6"].failure_signature == "Unknown failure" and list(t["6"].permanent_fix) == []


def test_alert_gate_and_texts(spark):
    rows = [("j", "CRITICAL"), ("k", "HIGH"), ("l", "MEDIUM"), ("m", "LOW")]
    df = spark.createDataFrame(rows, ["job_id", "severity"])
    assert {r.job_id for r in RP.alert_gate(df).collect()} == {"j", "k"}
    assert {r.job_id for r in RP.alert_gate(df, force=True).collect()} == {"j", "k", "l", "m"}
    assert RP.alert_gate(df, severities=[]).collect() == []
    tri = spark.createDataFrame(
        [("test_email_job", "Spark", "High", "CRITICAL", "OutOfMemoryError: GC overhead limit exceeded",
          "Executor ran out of heap memory during shuffle stage.",
          ["Increase executor memory", "Reduce shuffle partitions"], ["Fix data skew", "Enable AQE"],
          ["Check peak memory"], {"spark.executor.memory": "16g"},
          {"impact": "Daily ETL delayed", "resolution": "Pending", "preventive_actions": "Add memory alerts"},
          "t0", "yarn", "3.4.1")],
        "job_id string, category string, confidence string, severity string, failure_signature string, "
        "root_cause string, immediate_mitigation array<string>, permanent_fix array<string>, "
        "verify_steps array<string>, spark_config_recommendations map<string,string>, "
        "incident_notes map<string,string>, timestamp string, platform string, spark_version string")
    r = RP.alert_text(tri).first()
    assert r.subject == "[CRITICAL] Spark Job Failed: test_email_job | Spark | OutOfMemoryError: GC overhead limit exceeded"
    body = r.body.split("\n")
    assert body[0] == "\U0001F6A8 SPARK JOB FAILURE ALERT" and body[1] == "=" * 60
    assert "  1. Increase executor memory" in body and "  2. Reduce shuffle partitions" in body
    assert "  • Enable AQE" in body
    assert "⚙️  SPARK CONFIG RECOMMENDATIONS" in body and "  spark.executor.memory = 16g" in body
    assert "  Impact:   Daily ETL delayed" in body and "  Prevention: Add memory alerts" in body
    assert "heap memory" in r.body


def test_failure_context_and_log_text(spark):
    ti = {"dag_id": "my_dag", "task_id": "spark_task", "execution_date": "2026-03-02T08:00:00",
          "try_number": 2, "operator": "SparkSubmitOperator", "hostname": "airflow-worker-01",
          "log_url": "http://airflow/log"}
    schema = ("failure_id string, task_instance struct<dag_id:string,task_id:string,execution_date:string,"
              "try_number:int,operator:string,hostname:string,log_url:string>, "
              "ti struct<dag_id:string,task_id:string,execution_date:string,try_number:int,operator:string,"
              "hostname:string,log_url:string>, dag_run struct<dag_id:string,run_id:string,execution_date:string>, "
              "exception string")
    df = spark.createDataFrame([
        ("1", ti, None, None, "OOM error"),
        ("2", None, None, {"dag_id": "d2", "run_id": "r2", "execution_date": "2026-01-01 00:00:00"}, None),
        ("3", None, None, None, "boom"),
    ], schema)
    ctx = {r.failure_id: r for r in failure_context(df, "NOW", keep=["failure_id"]).collect()}
    assert (ctx["1"].dag_id, ctx["1"].task_id, ctx["1"].try_number, ctx["1"].exception) == ("my_dag", "spark_task", 2, "OOM error")
    assert (ctx["2"].dag_id, ctx["2"].task_id, ctx["2"].run_id, ctx["2"].execution_date) == ("d2", "unknown", "r2", "2026-01-01 00:00:00")
    assert (ctx["3"].dag_id, ctx["3"].run_id, ctx["3"].execution_date, ctx["3"].try_number) == ("unknown", "manual", "NOW", 1)
    c = failure_context(df, "NOW", keep=["failure_id"])
    files = spark.createDataFrame([("/l/my_dag/spark_task/2026-03-02T08_00_00/2.log", "log text")], "path string, text string")
    loc = locate_logs(c, files, "/l")
    res = {r.failure_id: r.log_text for r in resolve_log_text(loc, files).collect()}
    assert res["1"] == "log text"
    assert res["2"] == "Airflow task d2.unknown failed. No log available."
    assert res["3"] == "Airflow task failure — no log file found.\nDAG: unknown | Task: unknown | Run: manual\nException:\nboom"


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab é€\t")), max_size=12), min_size=1, max_size=12),
       st.integers(min_value=1, max_value=40), st.integers(min_value=1, max_value=4))
def test_tail_bytes_lines_match_python(spark, lines, max_bytes, chunk):
    from logsieve.sources.files import tail_bytes_lines
    df = spark.createDataFrame([("j", i + 1, v) for i, v in enumerate(lines)], "job_id string, line_no long, value string")
    got = tail_bytes_lines(df, max_bytes, chunk_lines=chunk).first().text
    raw = "".join(v + "\n" for v in lines).encode()
    assert got == raw[-max_bytes:].decode("utf-8", errors="replace")


def test_classify_join_equals_case(spark, data_dir):
    from logsieve.operators.classify import classify, classify_join, rule_table
    from logsieve.sources.files import read_logs
    lines = read_logs(spark, data_dir)
    a = {(r.job_id, r.line_no, r.label) for r in classify(lines).filter("label IS NOT NULL").collect()}
    b = {(r.job_id, r.line_no, r.label) for r in classify_join(lines, rule_table(spark)).collect()}
    assert a == b and len(a) > 10


def test_custom_rule_table_first_match_wins(spark):
    from logsieve.operators.classify import classify
    from logsieve.rules import rules_df
    rules = rules_df(spark, [(0, "disk", "Infra", "HIGH", "Disk"), (1, "full", "Infra", "LOW", "Full")])
    df = spark.createDataFrame([("j", 1, 1, "DISK is full"), ("j", 2, 2, "tank full"), ("j", 3, None, "   ")],
                               "job_id string, line_no long, idx long, value string")
    got = {r.line_no: r.label for r in classify(df, rules).collect()}
    assert got == {1: "Disk", 2: "Full", 3: None}


def test_skip_tiny_lines_matches_python(spark):
    from logsieve.sources.files import skip_tiny_lines
    texts = {"a": "  \n\n  x" + "y" * 40 + "  \n  z  \n\n", "b": "\n\n" + "q" * 49 + "\n\n", "c": "  " + "w" * 50 + " ",
             "d": "\n \n", "e": "a\n" * 30}
    df = spark.createDataFrame(list(texts.items()), "job_id string, text string")
    kept = {r.job_id for r in skip_tiny_lines(lines_from_text(df)).select("job_id").distinct().collect()}
    assert kept == {k for k, t in texts.items() if len("\n".join(t.splitlines()).strip()) >= 50}


def test_changed_files_and_manifest(spark):
    from logsieve.sources.files import changed_files
    listing = spark.createDataFrame([("a", 5), ("b", 3), ("c", 1)], "path string, mtime long")
    manifest = spark.createDataFrame([("a", 5), ("b", 2), ("d", 9)], "path string, mtime long")
    changed, new = changed_files(listing, manifest)
    assert {r.path for r in changed.collect()} == {"b", "c"}
    assert {(r.path, r.mtime) for r in new.collect()} == {("a", 5), ("b", 3), ("c", 1), ("d", 9)}


def test_corpus_numbering_independent_of_chunking(spark):
    import os

    import pytest
    from logsieve.checks.corpus import render_corpus
    path = "/root/testdata/sf0.001/events.parquet"
    if not os.path.exists(path):
        pytest.skip("test tables not present")
    ev = spark.read.parquet(path)
    a = render_corpus(ev)
    b = render_corpus(ev, rows_per_chunk=3)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


_KINDS = ["\tat a.B.c(D.java:1)", "Caused by: x", "plain text", "", "   ",
          "java.lang.OutOfMemoryError: heap", "Lost executor 3", "\tat java.base/x.Y(Z.java:1)"]


def _python_stacks(text):
    """The stack rule in plain Python: for the first hit of each label, look
    at the next 20 non-blank lines, skip to the first stack line and take the
    contiguous run of stack lines."""
    import re
    entries = [ln for ln in text.splitlines() if ln.strip()]
    labels = {"java.lang.OutOfMemoryError: heap": "OOM/Memory", "Lost executor 3": "ExecutorLost"}
    is_stack = lambda s: bool(re.match(r"^\s+at\s+[\w.$<>]+\(", s)) or "Caused by:" in s
    out = {}
    for i, e in enumerate(entries):
        lab = labels.get(e)
        if lab and lab not in out:
            run = []
            for x in entries[i + 1:i + 21]:
                if is_stack(x):
                    run.append(x.strip())
                elif run:
                    break
            out[lab] = "\n".join(run) or None
    return out


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(_KINDS), min_size=1, max_size=40), min_size=1, max_size=4))
def test_stack_rule_matches_brute_force(spark, logs):
    from logsieve import analyze
    texts = ["\n".join(x) for x in logs]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "job_id string, text string")
    rows = analyze(lines_from_text(df), as_of="t", materialize="none").collect()
    got = {r.job_id: {s.label: s.stack_trace for s in r.all_signals} for r in rows}
    for i, t in enumerate(texts):
        assert got.get(str(i), {}) == _python_stacks(t)


def test_triage_report_with_model_replies(spark):
    from logsieve import triage_report
    from tests.fixtures import CLEAN_LOG, OOM_LOG
    logs = spark.createDataFrame([("oom", OOM_LOG), ("clean", CLEAN_LOG)], ["job_id", "text"])
    reply = '```json\n{"category": "Infra", "severity": "MEDIUM", "failure_signature": "x"}\n```'
    replies = spark.createDataFrame([("oom", '{"category": "Data", "severity": "CRITICAL", "failure_signature": "OOM in stage 3"}', "m", 10),
                                     ("clean", reply, "m", 5)], "job_id string, raw string, model string, tokens long")
    rows = triage_report(lines_from_text(logs), as_of="T", replies=replies, recipients="a@x, b@y").collect()
    got = {(r.job_id, r.recipient, r.severity) for r in rows}
    assert got == {("oom", "a@x", "CRITICAL"), ("oom", "b@y", "CRITICAL")}     # MEDIUM is gated out
    assert rows[0].subject == "[CRITICAL] Spark Job Failed: oom | Data | OOM in stage 3"
    assert "Platform:    yarn" in rows[0].body and "Spark:       3.4.1" in rows[0].body


def test_all_evidence_is_kept_and_evidence_n_is_honoured(spark):
    import json
    text = "\n".join(f"24/01/01 00:00:0{i} ERROR Executor: java.lang.OutOfMemoryError: Java heap space {i}" for i in range(9))
    a = analyze(lines_from_text(spark.createDataFrame([("j", text)], "job_id string, text string")), as_of="T")
    record = json.loads(RP.analysis_json(a).first().json)
    assert len(record["primary_signal"]["evidence_lines"]) == 9
    assert set(record["primary_signal"]) == {"category", "pattern_matched", "severity", "evidence_lines", "stack_trace"}
    prompt = RP.build_prompt(a, evidence_n=8).first().prompt
    assert [f"space {i}" in prompt.split("=== ALL")[0] for i in range(9)] == [True] * 8 + [False]
    capped = analyze(lines_from_text(spark.createDataFrame([("j", text)], "job_id string, text string")), as_of="T", evidence_cap=2, tail_lines=3)
    row = capped.first()
    assert len(row.primary_signal.evidence) == 2 and len(row.log_tail.split("\n")) == 3


def test_unknown_severity_ranks_last(spark):
    text = "a HINT here\n24/01/01 00:00:00 ERROR Executor: java.lang.OutOfMemoryError: Java heap space"
    rules = [(-1, "HINT", "Own", "INFO", "own")] + R.DEFAULT_RULES
    a = analyze(lines_from_text(spark.createDataFrame([("j", text)], "job_id string, text string")), rules, as_of="T").first()
    assert a.primary_signal.severity == "CRITICAL" and [s.severity for s in a.all_signals][-1] == "INFO"


def test_triage_json_keeps_nulls_and_all_context_keys(spark):
    import json
    text = "24/01/01 00:00:00 ERROR Executor: java.lang.OutOfMemoryError: Java heap space"
    a = analyze(lines_from_text(spark.createDataFrame([("j", text)], "job_id string, text string")), as_of="T")
    t = RP.rule_triage(a).withColumn("severity", F.lit(None).cast("string"))
    alone, full = json.loads(RP.triage_json(t).first().json), json.loads(RP.triage_json(t, a).first().json)
    assert len(alone) == 13 and alone["severity"] is None and set(full) == {*alone, "job_context"}
    assert set(full["job_context"]) == {"job_name", "platform", "spark_version", "total_log_lines", "error_count", "warn_count", "failed_stages",
                                        "executors_lost", "oom_events", "shuffle_failures", "task_retries", "duration_seconds", "start_time", "end_time"}


def test_caches_are_handed_on(spark):
    from logsieve.plans.analyze import flat_analysis, release
    lines = lines_from_text(spark.createDataFrame([("j", "ERROR x")], "job_id string, text string"))
    for df in (triage_report(lines, as_of="T", only_failed=True), flat_analysis(analyze(lines, as_of="T"))):
        assert len(df._logsieve_cached) == 1
        release(df)


def test_checkpoint_folder_does_not_nest(spark):
    from logsieve.session import ensure_checkpoint_dir
    assert ensure_checkpoint_dir(spark) == ensure_checkpoint_dir(spark)


def test_instructions_name_the_keys_that_are_read(spark):
    a = analyze(lines_from_text(spark.createDataFrame([("j", "ERROR x")], "job_id string, text string")), as_of="T")
    row = RP.build_prompt(a, instructions=RP.MODEL_INSTRUCTIONS).first()
    keys = [c for c in RP.TRIAGE_COLUMNS if c not in ("job_id", "model_used", "tokens_used", "timestamp")]
    assert all(k in row.system for k in keys)


def test_large_rule_tables_go_to_classify_join(spark):
    import pytest
    from logsieve.operators.classify import classify, classify_join
    many = R.rules_df(spark, [(i, f"nothing{i}x", "c", "LOW", f"l{i}") for i in range(R.MAX_RULES)] + [(9999, "needle", "c", "LOW", "last")])
    lines = lines_from_text(spark.createDataFrame([("j", "hay\nneedle")], "job_id string, text string"))
    with pytest.raises(ValueError):
        classify(lines, many)
    few = many.where("prio > 1900")
    assert [(r.line_no, r.label) for r in classify_join(lines, few, block=30).collect()] == [(2, "last")]


def test_replies_are_read_as_python_reads_json(spark):
    """Equal keys, NaN, order of keys: what json.loads takes, and what it doesn't."""
    import json

    from logsieve.operators import report as RP
    replies = {
        "last": '{"category": "A", "severity": "LOW", "category": "B"}', "nan": '{"category": "B", "x": NaN, "y": [Infinity, -Infinity], "severity": "LOW"}',
        "in text": '{"category": "B", "severity": "LOW", "root_cause": "is NaN, not \\"Infinity\\" or \\\\"}', "named": '{"category": NaN, "severity": "LOW"}',
        "fenced": '```json\n{"severity": "LOW", "severity": "HIGH", "category": "B", "n": -Infinity}\n```', "span": 'so: {"severity": "LOW", "category": "B", "z": NaN} there',
        "maps": '{"severity": "LOW", "category": "B", "incident_notes": {"z": "1", "a": "2", "z": "3", "k": "4"}}',
        "order": '{"severity": "LOW", "category": "B", "x": 1, "x": NaN, "incident_notes": {"z": "1", "b": "2", "a": "3"}}',
        "bad": '{"severity": NaNs}', "bad2": '{"severity": "LOW"} {"category": "B"}', "bad3": "{'severity': 'LOW'}", "bad4": '{"severity": nan}',
    }
    df = spark.createDataFrame(list(replies.items()), "job_id string, raw string").selectExpr("*", "'m' AS model", "1 AS tokens")
    got = {r.job_id: r for r in RP.parse_response(df, "T").selectExpr("*", "map_keys(incident_notes) AS ks", "map_values(incident_notes) AS vs").collect()}
    for name, raw in replies.items():
        c = raw.strip().replace("```json", "").replace("```", "").strip()
        try:
            want = json.loads(c)
        except ValueError:
            try:
                want = json.loads(c[c.index("{"):c.rindex("}") + 1])
            except ValueError:
                want = None
        r = got[name]
        assert r.parsed == (want is not None), name
        if want:
            assert r.severity == want.get("severity", "HIGH") and r.category.lower() == str(want.get("category", "Spark")).lower(), name
            assert r.root_cause == want.get("root_cause", "")
            assert list(zip(r.ks, r.vs)) == list(want.get("incident_notes", {}).items()), name


def test_large_rule_tables_are_classified_in_blocks(spark):
    from logsieve import rules as R
    from logsieve.operators.classify import classify
    rules = [(i, f"marker{i}z", "C", "LOW", f"L{i}") for i in range(1203)] + [(1203, "marker", "C", "LOW", "any")]
    lines = spark.createDataFrame([("j", k, k, v) for k, v in enumerate(["marker700z marker3z", "a marker1202z b", "marker9999", "none"], 1)],
                                  "job_id string, line_no long, idx long, value string")
    got = [r.label for r in classify(lines, R.rules_df(spark, rules)).orderBy("line_no").collect()]
    assert got == ["L3", "L1202", "any", None]
