"""Helpers shared by the operators: lineage cuts, column lookup, word classes."""

from __future__ import annotations

import tempfile

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space of the word rule [^\x20\x09-\x0D]+ . ``bytes.split()`` splits on the same six bytes.
JAVA_SPACE = "[\\x20\\x09-\\x0D]+"


def ensure_shared_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: what the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to an own temporary folder; a cluster without the
    setting is an error, because executors would each write to their own disk.
    """
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if have:
        return have
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="logsieve-ckpt-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder; later plans start from there.

    A lost executor costs nothing: the files are reread. Spark removes them once the frame is
    garbage (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    ensure_shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_starts(lengths: Column, body: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """``body(start)``, where ``start(i)`` is the sum of the first i of ``lengths`` (array of bigint).

    Sums of blocks of sqrt(n) entries are made once, so a start costs two sqrt(n) sums, not n.
    """
    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)

    def blocks(v: Column) -> Column:
        w = F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1))
        return let(w, lambda w: let(
            F.transform(F.sequence(F.lit(0), (F.size(v) / w).cast("int")), lambda k: total(F.slice(v, k * w + 1, w))),
            lambda b: body(lambda i: let((i / w).cast("int"), lambda q: total(F.slice(b, 1, q)) + total(F.slice(v, q * w + 1, i - q * w))))))

    return let(lengths, blocks)


def free_names(names: list[str], taken: list[str]) -> list[str]:
    """``names``, each with underscores added until no column of ``taken`` has it in any case."""
    low, out = {c.lower() for c in taken}, []
    for n in names:
        while n.lower() in low:
            n += "_"
        out.append(n)
    return out
