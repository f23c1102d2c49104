"""Quality measures against plain counting."""

import random
import re
from collections import Counter

from logsieve.llm import quality_rules as QR

DOCS = "doc_id long, text string, N_WORDS string, _words int, broken int"


def plain(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
    n = Counter(grams)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {"n_words": len(ws), "word_chars": sum(map(len, ws)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
            "n_dup_lines": len(lines) - len(set(lines)), "n_lines": len(lines),
            "n_repeat_words": len({i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)})}


def test_measures(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t\x0b\x0c\r ", "one", "a b c", "a b c a b c", "a a a a", "a a a", "x\nx\n\nx\ny", "x \nx", "# * $ %&|<>#", "é ü 🙂 z  ",
             "a b " * 20_000, "word " * 50] + [" ".join(rng.choice("abcd") for _ in range(n)) for n in (3, 4, 5, 9, 30, 200)]
    texts += ["\n".join(rng.choice(["a", "b c", "", " ", "d"]) for _ in range(40)), " ".join(f"w{i}" for i in range(60_000)) + " w1 w2 w3"]
    df = spark.createDataFrame([(i, t, "k", 1, 2) for i, t in enumerate(texts)], DOCS)
    out = QR.quality_rules(df)
    assert out.columns == ["doc_id", "text", "_words", *QR.MEASURES, "broken", "base_failed", "kept"]
    for r in out.collect():
        want = plain(texts[r.doc_id])
        assert {k: r[k] for k in want} == want, texts[r.doc_id]
        failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        assert r.base_failed == failed and r.kept == (not r.broken) and (not failed or not r.kept)


def test_rules_of_the_table(spark):
    good = "\n".join(f"the cat{i} and the dog{i} sat on a mat{i} with number {i} of this list" for i in range(9))
    cases = {"symbols": good + " #" * 30, "shouting": good.upper(), "few_stop_words": " ".join(f"xq{i}" for i in range(200)),
             "ellipsis_lines": good.replace("list", "list..."), "bullet_lines": "- " + good.replace("\n", "\n- "),
             "words_too_long": " ".join("z" * 20 + f"{i} the" for i in range(60)).replace(" the", "", 55),
             "words_too_short": " ".join("abcdefghi"[i % 9] for i in range(60)) + " 1 2 3", "repeated_lines": "the cat and the dog sat on it\n" * 12 + good}
    df = spark.createDataFrame([(k, t) for k, t in {"": good, **cases}.items()], "doc_id string, text string")
    got = {r.doc_id: r.broken for r in QR.quality_rules(df).collect()}
    assert got[""] == []
    for k in cases:
        assert k in got[k], (k, got[k])


def test_empty_table(spark):
    assert QR.quality_rules(spark.createDataFrame([], DOCS)).collect() == []
