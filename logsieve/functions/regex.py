"""Regex helpers that give Java's engine the semantics of Python's ``re``.

Python patterns on ``str`` are Unicode-aware: ``\\d``, ``\\w``, ``\\s`` and
``\\b`` follow Unicode, ``re.IGNORECASE`` folds Unicode case, and ``.`` stops
only at ``\\n``. Java needs ``U`` (Unicode classes, implies Unicode case) and
``d`` (only ``\\n`` ends a line) for the same behaviour.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

CASE_INSENSITIVE = "(?iUd)"
CASE_SENSITIVE = "(?Ud)"
# Python's str.isspace(): Unicode White_Space plus the separators \x1c-\x1f.
WS = r"[\s\x1c-\x1f]"
NON_WS = r"[^\s\x1c-\x1f]"
WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"


def ci(pattern: str) -> str:
    """Pattern matched case-insensitively, Python-like classes."""
    return CASE_INSENSITIVE + pattern


def cs(pattern: str) -> str:
    """Pattern matched case-sensitively, Python-like classes."""
    return CASE_SENSITIVE + pattern


def needed_words(pattern: str) -> list[str] | None:
    """Lower-case ASCII words of which each match of ``pattern``, found case-insensitively in ASCII text, holds one: the longest
    run of plain characters in each alternative. None if the pattern has an alternative without one, or anything not read here."""
    if re.fullmatch(r"\([^()\[\\?][^()\[\\]*\)", pattern):
        pattern = pattern[1:-1]
    found, runs, plain, i = [], [""], False, 0
    while i <= len(pattern):
        c, was, plain = pattern[i:i + 1], plain, False
        if c in ("", "|"):
            found.append(max(runs, key=len))
            runs = [""]
        elif c == "\\":
            i += 1
            c = pattern[i:i + 1]
            if not c or c.isalnum() and c not in "bBdDsSwW":
                return None
            if c.isalnum():
                runs.append("")
            else:
                runs[-1] += c
                plain = True
        elif c in "*?":  # what is before may be missing
            if was:
                runs[-1] = runs[-1][:-1]
            runs.append("")
        elif c in ".+^$":
            runs.append("")
        elif c in "([":
            if c == "(" and (part := re.compile(r"\((?:\?:)?[^()\[?](?:[^()\[\\]|\\.)*\)").match(pattern, i)) \
                    or c == "[" and (part := re.compile(r"\[\^?[^][\\&^]+\]").match(pattern, i)):
                i = part.end() - 1
                runs.append("")
            else:
                return None
        elif c in ")]{}" or not c.isascii():
            return None
        else:
            runs[-1] += c
            plain = True
        i += 1
    words = {x.lower() for x in found}
    if any(len(x) < 2 for x in words):
        return None
    return sorted(x for x in words if not any(y != x and y in x for y in words))


def lowered(value: Column) -> Column:
    """ASCII text in lower case, NULL for other text: letters beyond ASCII match some ASCII letters case-insensitively.

    It isn't deterministic to Spark, so that it stays a column of its own: else each place that reads it would compute it."""
    return F.when((F.spark_partition_id() >= 0) & (F.octet_length(value) == F.char_length(value)), F.lower(value))


def may_match(low: Column | None, pattern: str) -> Column | None:
    """False only on lines (``low``: ``lowered``) that hold none of the words that ``pattern`` needs; None if there are none.

    Words are an array that one function goes through. A condition for each would be so much code in one method, with some fifteen rules, that
    Java interprets it for good instead of compiling it."""
    words = needed_words(pattern) if low is not None else None
    return F.coalesce(F.exists(F.array(*map(F.lit, words)), low.contains), F.lit(True)) if words else None


def rlike_ci(col: Column, pattern: str, low: Column | None = None) -> Column:
    """Whether the pattern matches. With ``low``, the pattern only runs on lines that hold a word it needs: finding
    words costs a small part of Java's case-insensitive search."""
    may, found = may_match(low, pattern), col.rlike(ci(pattern))
    return found if may is None else may & found


def first_group(col: Column, pattern: str, group: int = 1, *, ignore_case: bool = True, low: Column | None = None) -> Column:
    """Group of the first match, or NULL if there is none (Spark gives ''). ``low``: see ``rlike_ci``."""
    p = ci(pattern) if ignore_case else cs(pattern)
    may, found = may_match(low, pattern) if ignore_case else None, F.nullif(F.regexp_extract(col, p, group), F.lit(""))
    return found if may is None else F.when(may, found)


def py_strip(col: Column) -> Column:
    """``str.strip()``: drop leading and trailing Unicode whitespace.

    Spark's ``trim`` removes only spaces unless the characters are named. A pattern would be tried at every character.
    """
    return F.btrim(col, F.lit(WS_CHARS))


def is_blank(col: Column) -> Column:
    """True for a line with no non-whitespace character (``not line.strip()``)."""
    return ~col.rlike(f"(?U){NON_WS}")
