"""Personal data against Python's regular expressions and plain checksums."""

import hashlib
import random
import re

import pytest

from logsieve.llm import pii as PI
from logsieve.llm import queries as Q

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string"
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_luhn(digits):
    ds = [int(c) for c in digits][::-1]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(ds)) % 10 == 0


def plain_base(text):
    ok = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
          "card": lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and plain_luhn(d),
          "phone": lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15}
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if ok[k](m[0])]


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    rows = {r.doc_id: r for r in PI.digests(PI.find_pii(df)).collect()}
    spans = {r.doc_id: r.pii for r in PI.find_pii(df).collect()}
    for i, t in enumerate(texts):
        want = plain_base(t)
        got = [(s.kind, s.start, s.end) for s in spans[i]]
        assert [s for s in got if s[0] in PI.BASE] == want, (i, (t or "")[:80])
        assert rows[i].base_sha256 == hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in want).encode()).hexdigest()
        assert [rows[i][f"n_{k}"] for k in PI.BASE] == [sum(s[0] == k for s in want) for k in PI.BASE]
        assert rows[i].spans == ",".join(f"{a}:{b}:{c}" for a, b, c in got)
        assert all(s.text == t[s.start:s.end] for s in spans[i])
    return spans


def test_known_cases(spark):
    check(spark, [None, "", "a@b.c", "x a@b.c_x@d.e y", "a@b.c.d@e.f", "@a.b", "a@b", "é@a.bc 🙂 q@r.st", "..@a.b.c.", "a@b.c\nd@e.f",
                  "1.2.3.4.5.6.7.8", "256.1.1.1", "255.255.255.255", "0255.1.1.001", "999999999999999999999.1.1.1", "1.2.3", "v1.2.3.4",
                  "4111 1111 1111 1111", "4111-1111-1111-1111", "4111  1111", "4111111111111112", "0000000000000", "1" * 50,
                  "12.34.56.78 4111 1111 1111 1111", "+1 (375) 555-4393", "+12345678", "+123456789", "+1 2", "++12 345 678 90", "+1-.-.-.-23456789 +",
                  "call +49 30 901820 now 4863730426282943, or k@x.org"])


def test_random_texts(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([5, 40, 300])))
             for alphabet in ("a@.-1 +", "0123456789 .-", "+1234567890().- ", "ab1@._-% é\n", "4111- 0é🙂") for _ in range(60)]
    check(spark, texts)


def test_long_texts(spark):
    rng = random.Random(6)
    check(spark, ["a" * 3000, "1" * 3000, "." * 2000 + "a@b" + ".c" * 20_000, "1." * 4000, "1 " * 20_000, "+" * 9000 + "123456789",
                  " ".join(f"u{i}@x{i}.org" for i in range(500)), "+1" + "(" * 20_000,
                  " ".join("".join(rng.choice("0123456789") for _ in range(16)) for _ in range(1000))])


def test_very_long_runs_take_linear_time(spark):
    texts = ["a" * 1_000_000, "1" * 1_000_000, "a." * 400_000 + "@b.c", "9" * 500_000 + ".1.1.1"]
    rows = PI.find_pii(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()
    assert {r.doc_id: [s.kind for s in r.pii] for r in rows} == {0: [], 1: [], 2: ["email"], 3: []}


def test_added_kinds(spark):
    texts = ["account DE89 3704 0044 0532 0130 00.", "DE89370400440532013001", "my ssn is 123-45-6789", "code 123-45-6789", "SSN 000-45-6789",
             "tel 030 1234 56789", "030 1234 56789", "GB82WEST12345698765432 ok"]
    got = [[s.kind for s in v if s.kind not in PI.BASE] for _, v in sorted(check(spark, texts).items())]
    assert got == [["iban"], [], ["ssn"], [], [], ["phone_local"], [], ["iban"]]


def test_iban_ends_at_its_length(spark):
    texts = ["GB82WEST12345698765432 EUR 500", "DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "IBAN DE89370400440532013000 12 MAI, DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32",
             "NO93 8601 1117 947 KID 12345", "XX00 AAAA BBBB CCCC DE89 3704 0044 0532 0130 00 X", "DE89 3704 0044 0532 0130 01 BIC", "DE893704004405320130001"]
    got = [[s.text.replace(" ", "") for s in v if s.kind == "iban"] for _, v in sorted(check(spark, texts).items())]
    de, gb = "DE89370400440532013000", "GB82WEST12345698765432"
    assert got == [[gb], [de], [de, de, gb], ["NO9386011117947"], [de], [], []]


@pytest.mark.parametrize("text,want", [("a@b.c and 1.2.3.4", "[EMAIL] and [IP]"), ("", ""), (None, None), ("none", "none"),
                                       ("12.34.56.78 4111 1111 1111 1111!", "[IP] 4111 1111 1111 1111!"), ("é a@b.cz@q.rs x", "é [EMAIL]@q.rs x"),
                                       ("+4111 1111 1111 111 1x", "+4111 1111 1111 111 1x"), ("é\n+4917612345678\n", "é\n[PHONE]\n")])
def test_redaction(spark, text, want):
    df = spark.createDataFrame([(1, text, "k")], "doc_id long, text string, PII string")
    out = PI.redact(PI.find_pii(df)).collect()[0]
    if want and "4111" in want:  # whichever spans there are, none of them is left
        assert all(text[b:e] not in out.text for _, b, e in plain_base(text))
    else:
        assert out.text == want


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert PI.find_pii(df).collect() == [] and PI.redact(PI.find_pii(df)).columns == ["doc_id", "text"]


def test_query_on_table(spark):
    got = {r.doc_id: r for r in Q.op6_pii(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    n = 0
    for r in docs:
        want = plain_base(r.text)
        n += len(want)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in want).encode()).hexdigest()
    assert n
