"""Quality rules: one table of thresholds compiled into one Spark projection.

Every measure is a built-in function of the whole text (no user function, no shuffle): a first
projection splits the words, a second counts, a third compares each row of :data:`RULES` and
collects the names of the rules that a text breaks. Ratios are compared as whole numbers.

Words are runs of characters other than space and \\x09-\\x0D; lines are split at \\n.
``n_repeat_words`` counts the words that lie in a 3-word window found twice or more in the text.
Windows are compared by their 64-bit xxHash: two different windows of one text are taken for
equal with a chance of 2**-64 a pair.

Defined results: null text has no words, lines with words, or symbols, and so fails; an empty table
gives an empty result; repeated rows and null ids are judged each on its own; columns of the
input with the names of measures, in any case, are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.llm.common import JAVA_SPACE, free_names, let

WINDOW = 3
SYMBOLS = "#*$%&|<>"
# Frequent function words of English, French, German and Spanish (those without accents).
STOP_WORDS = ("a an and are as at be by for from in is it not of on or that the this to was with "
              "au avec ce dans de des du elle en est et il la le les ne pas pour que qui se sur un une "
              "auf das dem den der die ein eine es ich im ist mit nicht sich und von zu "
              "como con del el las lo los no para por su y").split()

#: Base rules: (name, left measure, times, right measure or number). A text breaks a rule if times * left > right.
BASE_RULES = (
    ("too_short", -1, "n_words", -50, None),              # fewer than 50 words
    ("repetitive", 100, "n_repeat_words", 50, "n_words"),  # more than half the words in repeated windows
)
#: The method's thresholds: (name, factor, measure, factor, measure); broken if factor * measure > factor * measure.
RULES = (
    ("too_long", 1, "n_words", 10_000_000, None),
    ("words_too_long", 10, "word_chars", 150, "n_words"),   # mean word over 15 characters
    ("words_too_short", 20, "n_words", 10, "word_chars"),   # mean word under 2 characters
    ("symbols", 10, "n_symbols", 1, "n_words"),             # over one symbol in ten words
    ("few_stop_words", 1, "n_words", 50, "n_stop_words"),   # under 2 % function words
    ("repeated_lines", 10, "n_dup_lines", 5, "n_lines"),    # over half the lines repeat an earlier one
    ("bullet_lines", 10, "n_bullet_lines", 9, "n_lines"),   # over 90 % of lines are list items
    ("ellipsis_lines", 10, "n_ellipsis_lines", 5, "n_lines"),
    ("shouting", 2, "n_upper_words", 1, "n_words"),         # over half the words in capitals
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines",
            "n_bullet_lines", "n_ellipsis_lines", "n_upper_words")


def repeat_words(words: Column, k: int = WINDOW) -> Column:
    """How many words lie in a k-word window that the text has twice or more."""
    n = F.size(words)
    hashes = F.transform(F.slice(words, 1, F.greatest(n - (k - 1), F.lit(0))),
                         lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, k)]))

    def places(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = let(pairs, lambda s: F.filter(s, lambda e, j: (F.get(s, j - 1)["h"] == e["h"]) | (F.get(s, j + 1)["h"] == e["h"])))
        return F.array_sort(F.transform(again, lambda e: e["i"]))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        return F.aggregate(at, start, lambda a, p: F.struct(
            (a["n"] + p + k - F.greatest(p, a["end"])).cast("long").alias("n"), (p + k).alias("end")), lambda a: a["n"])

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long"))
               .otherwise(covered(places(h))))


def _broken(rule: tuple) -> Column:
    _, f, left, g, right = rule
    return f * F.col(left) > (F.lit(g) if right is None else g * F.col(right))


def quality_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the measures, ``broken`` (names of broken rules), ``base_failed`` and ``kept``."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    added = {*MEASURES, "broken", "base_failed", "kept"}
    own = [c for c in docs.columns if c.lower() not in added]
    raw, ws, ls = free_names(["_text", "_words", "_lines"], docs.columns)
    split = docs.withColumn(raw, text).withColumn(
        ws, F.filter(F.split(raw, JAVA_SPACE, -1), lambda w: w != "")).withColumn(
        ls, F.filter(F.split(raw, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    words, lines = F.col(ws), F.col(ls)
    size = lambda c: F.size(c).cast("long")
    measures = {
        "n_words": size(words),
        "word_chars": F.length(F.translate(raw, " \t\n\x0b\f\r", "")).cast("long"),
        "n_symbols": (F.length(raw) - F.length(F.translate(raw, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": size(lines) - size(F.array_distinct(lines)),
        "n_repeat_words": repeat_words(words),
        "n_stop_words": size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))),
        "n_lines": size(lines),
        "n_bullet_lines": size(F.filter(lines, lambda x: x.rlike("^[\\x20\\t]*[-*+•‣▪●]"))),
        "n_ellipsis_lines": size(F.filter(lines, lambda x: x.rlike("(\\.\\.\\.|…)[\\x20\\t\\r]*$"))),
        "n_upper_words": size(F.filter(words, lambda w: (w == F.upper(w)) & (w != F.lower(w)) & (F.length(w) > 1))),
    }
    counted = split.select(*[F.col(f"`{c}`") for c in own], *[measures[m].alias(m) for m in MEASURES])
    name_if = lambda rules: [F.when(_broken(r), F.lit(r[0])) for r in rules]
    return counted.select(
        "*", F.filter(F.array(*name_if(BASE_RULES + RULES)), lambda x: x.isNotNull()).alias("broken"),
        _any(BASE_RULES).alias("base_failed"), (~(_any(BASE_RULES) | _any(RULES))).alias("kept"))


def _any(rules: tuple) -> Column:
    out = F.lit(False)
    for r in rules:
        out = out | _broken(r)
    return out


def duckdb_sql() -> str:
    """The thin query over ``documents``, in DuckDB's SQL."""
    def side(f, m):
        return f"{f}" if m is None else f"{f} * {m}"

    def anyof(rules):
        return "(" + " OR ".join(f"{side(f, a)} > {side(g, b)}" for _, f, a, g, b in rules) + ")"

    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    sp = r"[^\x20\x09-\x0D]"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, unnest(regexp_extract_all(t, '{sp}+')) AS w, generate_subscripts(regexp_extract_all(t, '{sp}+'), 1) AS i FROM d),
g AS (SELECT rid, i, w, lead(w, 1) OVER p AS w1, lead(w, 2) OVER p AS w2 FROM w WINDOW p AS (PARTITION BY rid ORDER BY i)),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w, w1, w2) AS n FROM g WHERE w2 IS NOT NULL),
r AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM c, (VALUES (0), (1), (2)) AS o(k) WHERE n > 1 GROUP BY rid),
a AS (SELECT rid, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (lower(w) IN ({stop})) AS n_stop_words,
      count(*) FILTER (w = upper(w) AND w <> lower(w) AND length(w) > 1) AS n_upper_words FROM w GROUP BY rid),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d),
b AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines,
      count(*) FILTER (regexp_matches(x, '^[\x20\t]*[-*+•‣▪●]')) AS n_bullet_lines,
      count(*) FILTER (regexp_matches(x, '(\.\.\.|…)[\x20\t\r]*$')) AS n_ellipsis_lines
      FROM l WHERE regexp_matches(x, '{sp}') GROUP BY rid),
m AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
      length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
      coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_stop_words, 0) AS n_stop_words,
      coalesce(n_upper_words, 0) AS n_upper_words, coalesce(n_lines, 0) AS n_lines,
      coalesce(n_bullet_lines, 0) AS n_bullet_lines, coalesce(n_ellipsis_lines, 0) AS n_ellipsis_lines
      FROM d LEFT JOIN a USING (rid) LEFT JOIN b USING (rid) LEFT JOIN r USING (rid))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, {anyof(BASE_RULES)} AS base_failed,
       NOT ({anyof(BASE_RULES)} OR {anyof(RULES)}) AS kept
FROM m"""
