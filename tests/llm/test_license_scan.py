"""Licence digests: variants of a text have its digest, other texts have not."""

import textwrap

from logsieve.llm import license_scan as LS

DOCS = "doc_id long, text string, unit int, Digest string"


def found(spark, texts):
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(texts)], DOCS)
    out = LS.scan(df, LS.known_licenses(spark))
    assert out.columns == ["doc_id", "Digest", "unit", "line_no", "spdx_id"]
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append((r.unit, r.line_no, r.spdx_id))
    return [sorted(got.get(i, [])) for i in range(len(texts))]


def test_variants(spark):
    mit = LS.TEXTS["MIT"]
    texts = [mit, mit.upper(), mit.replace("Copyright (c) <year> <copyright holders>", "Copyright © 2019-2024 Some One\n(C) 2020 Another"),
             mit.replace("MIT License", "MIT Licence").replace(" ", "  ").replace('"', "''"), mit.replace("free of charge", "for a charge"),
             "Released under the MIT License.", "some text\nLicensed under the Apache License, Version 2.0.\n\nmore", "licensed under CC BY-NC 4.0",
             "This work is licensed under the GNU General Public License, version 3.", "Not released under the MIT License.", None, "", "...\n\n!",
             "Copyright (c) 2020 Me", "the MIT License\nReleased under the MIT Licence", "x " * 200_000 + "\nLicense: ISC\n"]
    whole = ("text", 0, "MIT")
    assert found(spark, texts) == [[whole], [whole], [whole], [whole], [], [("text", 0, "MIT")], [("line", 2, "Apache-2.0")], [("text", 0, "CC-BY-NC-4.0")],
                                   [("text", 0, "GPL-3.0")], [], [], [], [], [], [("line", 2, "MIT")], [("line", 2, "ISC")]]


def test_own_table_and_shared_digest(spark):
    known = spark.createDataFrame([("A", "Some text!"), ("B", "some  TEXT"), ("C", None), ("D", "")], "spdx_id string, text string")
    docs = spark.createDataFrame([(1, "some text"), (1, "some text"), (None, "SOME, text.")], "doc_id long, text string")
    rows = sorted((str(r.doc_id), r.spdx_id) for r in LS.scan(docs, known).collect())
    assert rows == [("1", "A"), ("1", "A"), ("1", "B"), ("1", "B"), ("None", "A"), ("None", "B")]
    assert LS.scan(docs.limit(0), known).collect() == []


def wholes(spark, texts):
    return [{i for unit, _, i in v if unit == "text"} for v in found(spark, texts)]


def test_full_texts_with_and_without_title(spark):
    files = {f.stem: f.read_text() for f in LS.FOLDER.glob("*.txt")}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "Unlicense"} <= set(files)
    assert wholes(spark, list(files.values())) == [{i} for i in files]
    mit, apache, bsd = LS.TEXTS["MIT"].split("\n", 1)[1], files["Apache-2.0"], files["BSD-3-Clause"]
    numbered = bsd.replace("* Redistributions of", "1. Redistributions of").replace("* Redistributions in", "2. Redistributions in").replace("* Neither", "3. Neither")
    terms = apache[:apache.index("APPENDIX")]
    cases = [("MIT", mit), ("MIT", "The MIT License (MIT)\n" + mit), ("MIT", "MIT License\n" + mit), ("Apache-2.0", terms), ("Apache-2.0", apache.replace("[yyyy] [name of copyright owner]", "Jane Doe")),
             ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2019, Foo\nAll rights reserved.\n\n" + numbered), ("MPL-2.0", files["MPL-2.0"].split("\n", 2)[2]),
             ("GPL-3.0", files["GPL-3.0"][:files["GPL-3.0"].index("How to Apply")])]
    assert wholes(spark, [t for _, t in cases]) == [{i} for i, _ in cases]


def test_owner_lines_of_any_form_are_dropped(spark):
    mit, zlib = LS.TEXTS["MIT"].split("\n\n", 2)[2], LS.TEXTS["Zlib"].split("\n\n", 1)[1]
    heads = ["Copyright Jane Doe", "Copyright The Foo Authors", "(c) Jane Doe", "Portions copyright 2001 Foo Inc.", "© The Foo Contributors\nAll rights reserved.",
             "Copyright: Foo, Bar and others. All Rights Reserved", "(c) Copyright Foo GmbH"]
    assert wholes(spark, [f"MIT License\n\n{h}\n\n{mit}" for h in heads]) == [{"MIT"}] * len(heads)
    assert wholes(spark, [f"{h}\n\n{zlib}" for h in heads]) == [{"Zlib"}] * len(heads)


def test_sentences_of_licences_are_no_owner_lines(spark):
    lines = ["copyright notice and this permission notice shall be included", "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM", "copyright law. That is to say", "(c) You must retain, in the Source form",
             "copyright license to reproduce", "No rights reserved.", "All rights reserved by others are granted"]
    df = spark.createDataFrame([(x,) for x in lines], "t string")
    assert all(r.c[0] for r in df.select(LS.canonical_lines("t").alias("c")).collect())
    files = {f.stem: f.read_text() for f in LS.FOLDER.glob("*.txt") if f.stem in ("BSD-2-Clause", "BSD-3-Clause", "Unlicense")} | {i: LS.TEXTS[i].split("\n\n", 2)[2] for i in ("MIT", "ISC")}
    wrapped = [(i, "\n\n".join(textwrap.fill(x, w, break_on_hyphens=False, break_long_words=False) for x in t.split("\n\n"))) for i, t in files.items() for w in range(35, 100, 6)]
    assert wholes(spark, [t for _, t in wrapped]) == [{i} for i, _ in wrapped]
