"""Exact, skew-safe line numbering.

A log may be far larger than one task can hold, and one job may own a third
of the corpus, so no window ever spans a whole job. Lines are numbered in two
levels instead:

1. rows are cut into *chunks* by a column that is monotone in the line order
   (an input split, a time slice, a block of positions) and numbered
   inside each (job, chunk) with ``row_number``;
2. per (job, chunk) sizes are summed into offsets - a table of one row per
   chunk - and joined back on (job, chunk).

The lines are shuffled once (hash on job + chunk, for the window); the sizes
are a partial aggregate of the same rows, so only the small size table moves
otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.regex import is_blank


def number_lines(
    df: DataFrame,
    keys: list[str],
    chunk: Column,
    order: list[Column],
    value_col: str = "value",
) -> DataFrame:
    """Add ``line_no`` (1-based over all rows of a key, blanks included),
    ``idx`` (1-based over non-blank rows; NULL on blank rows) and ``n_text`` (the key's non-blank rows).

    ``chunk`` must be non-decreasing along ``order`` within each key.
    """
    df = (
        df.withColumn("_chunk", chunk)
        .withColumn("_nb", F.when(is_blank(F.col(value_col)), 0).otherwise(1))
    )
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    local = df.withColumn("_rn", F.row_number().over(w)).withColumn(
        "_rnb", F.sum("_nb").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    # Chunk sizes from the unshuffled rows: a map-side partial aggregate, so
    # only one small row per (task, key, chunk) moves. (Deriving them from the
    # window output does not reuse its exchange: column pruning makes the two
    # exchanges differ, and all lines would be shuffled twice.)
    sizes = df.groupBy(*keys, "_chunk").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_nb").alias("_nnb")
    )
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys,
        "_chunk",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        F.coalesce(F.sum("_nnb").over(before), F.lit(0)).alias("_offnb"),
        F.sum("_nnb").over(Window.partitionBy(*keys)).alias("n_text"),
    )
    out = local.join(offsets, on=[*keys, "_chunk"], how="inner")
    return (
        out.withColumn("line_no", (F.col("_off") + F.col("_rn")).cast("bigint"))
        .withColumn("idx", F.when(F.col("_nb") == 1, (F.col("_offnb") + F.col("_rnb")).cast("bigint")))
        .drop("_chunk", "_nb", "_rn", "_rnb", "_off", "_offnb")
    )
