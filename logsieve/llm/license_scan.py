"""License scans by canonical digests: whole texts against known licences, by one hash join.

A text is made canonical by Spark expressions: lower case, copyright lines dropped, equivalent spellings
unified, punctuation and white space reduced to single spaces. Its SHA-256 is looked up in the digests of the
known texts, made canonical by the same expressions. Looked up are the whole document, and each of its lines as a text of
its own (so that a notice line is found in a longer document); nothing is matched in part.

The known texts are a table (spdx_id, text): any DataFrame of that shape; :func:`known_licenses` holds the full texts in the
folder ``licenses`` and in :data:`TEXTS`, each with and without its usual titles and its appendix, and one-line
notices. AGPL-3.0 and the CC-BY family have notices only. Its digests are broadcast up to :data:`MAX_BROADCAST` of them (they are counted
first), and beyond that joined by a shuffle of digests.

Defined results: null and empty texts, and texts that are nothing but copyright lines and punctuation, match
nothing; repeated rows are scanned each on its own, null ids too; a digest that two licences share gives both; an empty table gives an
empty result; columns of the input named like an added one, in any case, are replaced.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.llm.common import free_names, let

# Public licence names, notices and texts, which must equal the originals.
NOTICE_FORMS = ("Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "Released under {}.", "Distributed under the {}.",
                "This work is licensed under the {}.", "This work is licensed under {}.", "This project is licensed under the {}.",
                "This file is licensed under the {}.", "Available under the {}.", "Published under the {}.", "License: {}", "SPDX-License-Identifier: {}")
NAMES = {
    "MIT": ("MIT", "MIT License"),
    "Apache-2.0": ("Apache-2.0", "Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 License"),
    "GPL-2.0": ("GPL-2.0", "GPLv2", "GNU General Public License, version 2", "GNU GPL version 2"),
    "GPL-3.0": ("GPL-3.0", "GPLv3", "GNU General Public License, version 3", "GNU GPL version 3"),
    "LGPL-2.1": ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    "LGPL-3.0": ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    "AGPL-3.0": ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    "MPL-2.0": ("MPL-2.0", "Mozilla Public License 2.0", "Mozilla Public License, version 2.0"),
    "BSD-2-Clause": ("BSD-2-Clause", "BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD-3-Clause", "BSD 3-Clause License", "New BSD License"),
    "ISC": ("ISC", "ISC License"),
    "CC0-1.0": ("CC0-1.0", "CC0 1.0"),
    "Unlicense": ("Unlicense",),
    **{f"CC-BY{x}-{v}": (f"CC-BY{x}-{v}", f"CC BY{x} {v}") for x in ("", "-SA", "-ND", "-NC", "-NC-SA", "-NC-ND") for v in ("3.0", "4.0")},
}
TEXTS = {
    "MIT": """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """ISC License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    "Zlib": """Copyright (c) <year> <copyright holders>

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
}
#: Full texts, one file for each SPDX id; and the title lines that a file begins with.
FOLDER = Path(__file__).with_name("licenses")
TITLE_LINES = {"Apache-2.0": 3, "CC0-1.0": 2, "MPL-1.1": 2, "MPL-2.0": 1, "GPL-1.0": 2, "GPL-2.0": 2, "GPL-3.0": 2, "LGPL-2.0": 2,
               "LGPL-2.1": 2, "LGPL-3.0": 2, "GFDL-1.2": 2, "GFDL-1.3": 2}
#: Usual titles of texts that circulate under several.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "ISC"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License", "BSD License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
    "Apache-2.0": ("Apache License, Version 2.0",),
}
#: The line after which licences say how to apply them.
END_OF_TERMS = re.compile(r"^\s*END OF TERMS AND CONDITIONS\s*$", re.M)
#: Digests broadcast at most: 100 bytes each, 10 MB.
MAX_BROADCAST = 100_000
#: Equivalent spellings, (pattern on lower-case text, replacement), applied in this order.
SPELLINGS = (("licen[cs]e", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"), ("organisation", "organization"),
             ("favour", "favor"), ("acknowledgement", "acknowledgment"), ("copyright owner", "copyright holder"), ("per cent", "percent"),
             ("https?://", ""), ("©", "(c)"), ("&", " and "), ("version ([0-9])", "$1"), ("([^a-z0-9])v([0-9])", "$1$2"))
#: Everything but letters, digits and line ends.
PUNCTUATION = r"[^\p{L}\p{N}\n]+"
#: Lines, after all that, that only say whose copyright it is.
COPYRIGHT = "^(copyright (c |[0-9]{4})|c [0-9]{4})"
#: Words that follow "copyright" in a licence's own sentences, at whose line ends these may be wrapped, and "(c)" in its lists.
SENTENCE = r"""holder\w* notices? and law laws line lines disclaimers? owners? interests? on permission resulting license licenses also like those
    treaty treaties are is if doctrines? ownership patent statements? or of in to as for by that which shall will may must rights? protection act
    information management status material works? infringement claims? covering applies apply""".split()
ITEM = """accompany a an any all by cause convey do each every for from give if in is it its may must no not of on or state such that the their they this to
    under use when where which with you your prohibiting rename representations distribute affirmer licenses license""".split()
#: Lines, in canonical form, that only say whose copyright it is, whoever that may be, or reserve rights. Besides those of
#: :data:`COPYRIGHT` they are short.
OWNER = (COPYRIGHT + r"|^(?=.{1,120}$)(?:c |portions (?:are )?)?copyright (?!(?:" + "|".join(SENTENCE) + r")\b|the(?: \S+){8,})\S|^(?=.{1,120}$)portions (?:are )?copyright "
         r"|^c (?!(?:" + "|".join(ITEM) + r")\b)\S+(?: \S+){0,5}$|^c the(?: \S+){0,4} (?:authors?|contributors?|developers?|team|project|foundation)$"
         r"|^(?:all|some) rights reserved(?: worldwide)?$")


def canonical_lines(text: Column) -> Column:
    """The lines of ``text`` in canonical form; copyright lines and lines without letters or digits are empty."""
    out = F.lower(text)
    for pattern, by in (*SPELLINGS, (PUNCTUATION, " ")):
        out = F.regexp_replace(out, pattern, by)
    return F.transform(F.split(out, "\n", -1), lambda x: let(F.trim(x), lambda x: F.when(x.rlike(OWNER), "").otherwise(x)))


def known_licenses(spark: SparkSession) -> DataFrame:
    """(spdx_id, text): full texts in their usual variants, and notices made from every form and name."""
    return spark.createDataFrame([*_known(), *full_texts()], "spdx_id string, text string")


def full_texts() -> list[tuple[str, str]]:
    """Every full text with and without title, with points or numbers, and whole, up to the end of its terms, and without the line that marks this."""
    out = []
    files = {f.stem: f.read_text(encoding="utf-8") for f in sorted(FOLDER.glob("*.txt"))}
    for spdx_id, text in [*((i, t) for i, t in TEXTS.items() if i not in files), *files.items()]:
        lines = text.strip().splitlines()
        if spdx_id in TITLES and lines[0] in TITLES[spdx_id]:
            lines = lines[1:]
        filled = [k for k, line in enumerate(lines) if re.search(r"\w", line)]
        skip = TITLE_LINES.get(spdx_id, 0)
        bare = "\n".join(lines[filled[skip]:])
        for body in [x for x in ("\n".join(lines) if skip else None, bare, *(f"{t}\n{bare}" for t in TITLES.get(spdx_id, ()))) if x]:
            if "\n* " in body:
                count = iter(range(1, 100))
                out.append((spdx_id, re.sub(r"^\* ", lambda _: f"{next(count)}. ", body, flags=re.M)))
            ends = list(END_OF_TERMS.finditer(body))
            out += [(spdx_id, body), *((spdx_id, body[:at]) for m in ends[-1:] for at in m.span())]
    return out


def _known() -> list[tuple[str, str]]:
    return [*TEXTS.items(), *((i, f.format(n)) for i, names in NAMES.items() for n in names for f in NOTICE_FORMS)]


def _units(rows: DataFrame, text_col: str, keep: list[str], names: list[str], lines: bool) -> DataFrame:
    """One row per unit (the whole text; its lines, if there are several) with its digest."""
    unit, line_no, digest, temp = names
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    made = rows.select(*[F.col(f"`{c}`") for c in keep], canonical_lines(text).alias(temp))
    full = F.array(F.struct(F.lit("text").alias(unit), F.lit(0).cast("long").alias(line_no),
                            F.array_join(F.filter(temp, lambda x: x != ""), " ").alias(digest)))
    each = F.transform(temp, lambda x, i: F.struct(F.lit("line").alias(unit), (i + 1).cast("long").alias(line_no), x.alias(digest)))
    units = F.concat(full, F.when(F.size(F.filter(temp, lambda x: x != "")) > 1, each).otherwise(F.slice(full, 1, 0))) if lines else full
    out = made.select(*[F.col(f"`{c}`") for c in keep], F.explode(units).alias(temp)).select(*[F.col(f"`{c}`") for c in keep], f"{temp}.*")
    return out.where(F.col(digest) != "").withColumn(digest, F.sha2(digest, 256))


def scan(docs: DataFrame, known: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all but the text by default) with ``unit`` ("text" or "line"), ``line_no`` (0 for the
    text, else from 1) and ``spdx_id``: one row for each unit and licence whose digests are equal.

    ``known``: (spdx_id, text). Texts are never shuffled; digests only if ``known`` is too large to broadcast.
    """
    added = ("unit", "line_no", "spdx_id")
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in added and (keep is not None or c != text_col)]
    digest, temp = free_names(["digest", "_u"], [*docs.columns, *added])
    table = _units(known, "text", ["spdx_id"], ["_a", "_b", digest, "_t"], False).select("spdx_id", digest).distinct()
    if table.count() <= MAX_BROADCAST:
        table = F.broadcast(table)
    units = _units(docs, text_col, keep, ["unit", "line_no", digest, temp], True)
    return units.join(table, digest).select(*[F.col(f"`{c}`") for c in keep], *added)


def probes() -> list[tuple[int, str]]:
    """(-1, -2, ...; a whole licence text as it circulates, with an owner): one of each licence whose full text is known."""
    last = {i: t for i, t in full_texts()}
    return [(-k, f"Copyright (c) 2021 Jane Doe and others\n\n{last[i]}\n") for k, i in enumerate(sorted(last), 1)]


def duckdb_sql() -> str:
    """The scan of ``documents`` and the :func:`probes`, by the same table and the same rules; :data:`OWNER` is said without looking ahead."""
    q = lambda t: "'" + t.replace("'", "''") + "'"
    start = "^(?:c |portions (?:are )?)?copyright "

    def owner(x: str) -> str:
        short = f"length({x}) BETWEEN 1 AND 120"
        named = (f"regexp_matches({x}, '{start}\\S') AND NOT regexp_matches({x}, '{start}(?:{'|'.join(SENTENCE)})\\b') "
                 f"AND NOT regexp_matches({x}, '{start}the(?: \\S+){{8,}}')")
        item = f"regexp_matches({x}, '^c \\S+(?: \\S+){{0,5}}$') AND NOT regexp_matches({x}, '^c (?:{'|'.join(ITEM)})\\b')"
        plain = "|".join((COPYRIGHT, r"^c the(?: \S+){0,4} (?:authors?|contributors?|developers?|team|project|foundation)$",
                          r"^(?:all|some) rights reserved(?: worldwide)?$"))
        return f"(regexp_matches({x}, '{plain}') OR ({short} AND ({named} OR regexp_matches({x}, '^portions (?:are )?copyright '))) OR ({item}))"

    def lines(c: str) -> str:
        out = f"lower({c})"
        for pattern, by in (*SPELLINGS, (PUNCTUATION, " ")):
            by = by.replace("$", chr(92))
            out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
        return f"[CASE WHEN {owner('trim(x)')} THEN '' ELSE trim(x) END for x in string_split({out}, chr(10))]"

    known = ", ".join(f"({q(i)}, {q(t)})" for i, t in dict.fromkeys([*_known(), *full_texts()]))
    planted = ", ".join(f"({i}, {q(t)})" for i, t in probes())
    return f"""
WITH k AS (SELECT spdx_id, {lines("text")} AS l FROM (VALUES {known}) AS v(spdx_id, text)),
known AS (SELECT DISTINCT spdx_id, sha256(array_to_string([x for x in l if x <> ''], ' ')) AS digest FROM k),
texts AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {planted}) AS p(doc_id, text)),
d AS (SELECT doc_id, {lines("coalesce(text, '')")} AS l FROM texts),
u AS (SELECT doc_id, 'text' AS unit, 0 AS line_no, array_to_string([x for x in l if x <> ''], ' ') AS c FROM d
      UNION ALL SELECT doc_id, 'line', i, l[i] FROM (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS i FROM d
                                                     WHERE len([x for x in l if x <> '']) > 1))
SELECT u.doc_id, u.unit, CAST(u.line_no AS BIGINT) AS line_no, k.spdx_id
FROM u JOIN known k ON k.digest = sha256(u.c) WHERE u.c <> ''"""
