"""The corpus pipeline: documents in, packed training sequences out.

Five stages, each calling one operator of ``logsieve.llm`` on all rows that its predecessor kept:
low quality goes, one document of each near-duplicate group stays, contaminated documents go, personal
data is replaced, and what is left is packed. Every stage's output is written as Parquet to the
folder that executors share (``spark.checkpoint.dir``) and read again, so a lost executor never
costs more than the stage at hand.

All but the last stage return the columns of ``documents``. A document whose text the personal-data stage
changes has its ``n_chars`` set to the new length. Null and empty texts, repeated rows, null ids and empty
tables are handled as each operator states.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.llm import decontaminate as DC
from logsieve.llm import pii as PI
from logsieve.llm import quality_classifier as QC
from logsieve.llm import queries as Q
from logsieve.llm import simhash as SH
from logsieve.llm.common import ensure_shared_dir


def on_safe_names(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage(docs)`` with the columns of ``docs``, whatever they are called: all but doc_id and text pass
    the operator under names that it can't add itself."""
    safe = {c: f"passing_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    out = stage(docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(n) for c, n in safe.items()]))
    return out.select(*[F.col(safe.get(c, c)).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the quality classifier, fitted on the labelled rows that aren't held out, accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = QC.fit(QC.training_rows(docs, labels))
    return on_safe_names(docs, lambda d: QC.score(d, model).where("predicted = 1"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash group, that of the smallest id."""
    return SH.one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a twentieth or more of their words inside benchmark windows."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return on_safe_names(docs, lambda d: DC.decontaminate(d, benchmark).where("NOT (n_hit > 0 AND 20 * n_hit >= n_words)"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every span of personal data by its kind in brackets."""
    clean = on_safe_names(docs.withColumn("text before", F.col("text")), lambda d: PI.redact(PI.find_pii(d)))
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        clean = clean.withColumn("n_chars", F.when(F.col("text") != F.col("`text before`"), size).otherwise(F.col("n_chars")))
    return clean.select(*[F.col(f"`{c}`") for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents left; one row per piece, as ``op2_packing`` returns them."""
    return Q.packed(docs)


STAGES = [("quality_classifier", quality), ("simhash_dedup", near_duplicates), ("decontamination", decontamination),
          ("pii", personal_data), ("packing", packing)]

#: A fitted classifier, XXH64 fingerprints and a tokenizer can't be expressed in SQL; tests/llm/test_pipeline.py
#: compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. The stages' files are removed when the session's JVM ends."""
    home = f"{ensure_shared_dir(spark).rstrip('/')}/corpus-pipeline-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(home)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        docs = spark.read.parquet(f"{home}/{name}")
    return docs
