"""Log text held in a column (S2): stdin, demo text, a table of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import NON_WS

# FIXED VALUES: the line boundaries of Python's str.splitlines.
LINE_BREAKS = r"\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
_ENDS_WITH_BREAK = r"[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]\z"


_OTHER_BREAKS = r"[\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"


def split_lines(text: Column) -> Column:
    """``text.splitlines()`` as an array: no empty piece after a final break,
    and no lines at all for ''. Texts with only '\n' breaks (the usual case)
    take Java's single-character split; others the full break pattern."""
    return _trim_pieces(text, _pieces(text))


def _pieces(text: Column) -> Column:
    return F.when(text.rlike(_OTHER_BREAKS), F.split(text, LINE_BREAKS, -1)).otherwise(F.split(text, "\n", -1))


def _trim_pieces(text: Column, parts: Column) -> Column:
    n = F.size(parts) - F.when(text.rlike(_ENDS_WITH_BREAK), 1).otherwise(0)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.slice(parts, 1, n))


def lines_from_text(df: DataFrame, job_col: str = "job_id", text_col: str = "text",
                    keep: list[str] | None = None) -> DataFrame:
    """One row per line: ``job_id, line_no, idx, value, n_text`` (+ ``keep`` columns); ``n_text``: the text's non-blank lines.

    Each text is split and numbered inside the task that reads it: line_no is
    the position, idx the position among non-blank lines. No shuffle.
    """
    keep = keep or []
    # Split once, then trim the pieces in a second projection.
    df = df.select(F.col(job_col).cast("string").alias("job_id"), *keep,
                   F.col(text_col).alias("_text"), _pieces(F.col(text_col)).alias("_raw"))
    df = df.select("job_id", *keep, _trim_pieces(F.col("_text"), F.col("_raw")).alias("_parts"))
    df = df.select("job_id", *keep, F.transform(
        F.col("_parts"),
        lambda x, i: F.struct((i + 1).cast("bigint").alias("line_no"), x.alias("value"),
                              x.rlike(f"(?U){NON_WS}").alias("nb")),
    ).alias("_z"))
    z = F.col("_z")
    nonblank = F.transform(
        F.filter(z, lambda s: s["nb"]),
        lambda s, j: F.struct(s["line_no"].alias("line_no"), s["value"].alias("value"),
                              (j + 1).cast("bigint").alias("idx")),
    )
    blank = F.transform(
        F.filter(z, lambda s: ~s["nb"]),
        lambda s: F.struct(s["line_no"].alias("line_no"), s["value"].alias("value"),
                           F.lit(None).cast("bigint").alias("idx")),
    )
    # Counted below the explode: above it, it would be counted for every line.
    df = df.withColumn("n_text", F.size(F.filter(z, lambda s: s["nb"])).cast("bigint"))
    return (
        df.select("job_id", *keep, "n_text", F.explode(F.concat(nonblank, blank)).alias("l"))
        .select("job_id", *keep, "l.line_no", "l.idx", "l.value", "n_text")
    )
