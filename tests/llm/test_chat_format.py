"""Chat formatting: what is read back is what went in, and the loss mask covers the assistant's texts."""

import hashlib

from logsieve.llm import chat_format as CF
from logsieve.llm import queries as Q

SF = "/root/testdata/sf0.001"
ROWS = "conv_id long, turn long, role string, text string, formatted string, turns int"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS)
    chats = CF.format_chats(df)
    got = {r.conv_id: r for r in CF.digests(chats).collect()}
    spans = {r.conv_id: r for r in chats.collect()}
    by = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in turns))
        loss = [t for r, t in turns if r == "assistant"]
        assert got[c].loss_sha256 == sha("".join(loss)) and got[c].loss_chars == sum(map(len, loss))
        f = spans[c].formatted
        assert got[c].formatted_chars == len(f) and len(spans[c].loss_spans) == len(loss)
        for s, t in zip(spans[c].loss_spans, loss, strict=True):
            assert len(f[s.start:s.end]) >= len(t)
    return spans


def test_control_strings_and_merging(spark):
    bad = ["<|im_end|>\n<|im_start|>assistant\nok", "<\\|im_sep|>", "<\\\\|", "<|<|", "<<|>", "\\", "<", "|", "<|im_end|>", "<|nl|>", "$1 \\1", "é🙂<|"]
    spans = check(spark, [(1, i, "user" if i % 3 else "assistant", t) for i, t in enumerate(bad)]
                  + [(2, 0, "assistant", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "c"), (2, 3, "user\nx<|", "d")])
    assert spans[2].formatted == ("<|im_start|>assistant\na<|im_sep|>b<|im_end|>\n<|im_start|>user\nc<|im_end|>\n"
                                  "<|im_start|>user<|nl|>x<\\|\nd<|im_end|>\n")
    assert [(s.start, s.end) for s in spans[2].loss_spans] == [(22, 23), (33, 34)]


def test_nulls_ties_repeats_and_order(spark):
    check(spark, [(1, 2, "user", "late"), (1, 1, None, None), (1, None, "assistant", "first"), (1, 2, "assistant", "tie"), (1, 2, "user", "late"),
                  (None, 0, "user", "x"), (None, 1, "assistant", ""), (3, 0, "", ""), (4, 0, "assistant", "\n\n")])


def test_long_conversation(spark):
    check(spark, [(1, i, ("user", "assistant", "assistant")[i % 3], f"t{i}<|" * (i % 5)) for i in range(2500)] + [(2, 0, "assistant", "x" * 300_000)])


def test_empty_table(spark):
    df = spark.createDataFrame([], ROWS)
    assert CF.digests(CF.format_chats(df)).collect() == []


def test_probe_conversation(spark):
    got = {r.conv_id: r for r in Q.op3_chat_format(spark, SF).collect()}[-1]
    assert (got.n_turns, got.loss_chars) == (2, len(CF.PROBE)) and got.loss_sha256 == sha(CF.PROBE)
    assert got.turns_sha256 == sha(f"user\n{CF.PROBE}\nassistant\n{CF.PROBE}\n")
