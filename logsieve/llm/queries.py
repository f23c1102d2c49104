"""Registered queries of the training-data operators: thin, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.llm import chat_format as CF
from logsieve.llm import decontaminate as DC
from logsieve.llm import html_extract as HX
from logsieve.llm import jaccard_join as JJ
from logsieve.llm import license_scan as LS
from logsieve.llm import packing as PK
from logsieve.llm import pii as PI
from logsieve.llm import quality_classifier as QC
from logsieve.llm import quality_rules as QR
from logsieve.llm import ranked_search as RS
from logsieve.llm import simhash as SH
from logsieve.llm import toxicity as TX
from logsieve.llm import vector_codes as VC


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def tokenizer_files() -> dict[str, str]:
    """The public tokenizer's files; their folder is the installed package's."""
    import public_tokenizers as P

    return {"vocab": P.path("byte_bpe_50k.json"), "ranks": P.path("byte_bpe_50k.tiktoken"), "pattern": P.PATTERN}


def op1_license_scan(spark, d):
    """All documents, and one whole text of each licence known in full, under negative ids."""
    probes = spark.createDataFrame(LS.probes(), "doc_id long, text string")
    return LS.scan(_t(spark, d, "documents").select("doc_id", "text").unionByName(probes), LS.known_licenses(spark))


def op2_packing(spark, d):
    return packed(_t(spark, d, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    pieces = PK.pack(docs, **tokenizer_files())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


def op3_chat_format(spark, d):
    probe = spark.createDataFrame([(-1, 0, "user", CF.PROBE), (-1, 1, "assistant", CF.PROBE)],
                                  "conv_id long, turn long, role string, text string")
    rows = _t(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return CF.digests(CF.format_chats(rows.unionByName(probe)))


def op4_html_extraction(spark, d):
    found = HX.extract(_t(spark, d, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_quality_classifier(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "text")
    model = QC.fit(QC.training_rows(docs, _t(spark, d, "labels")))
    return QC.score(docs, model).select("doc_id", QC.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_pii(spark, d):
    return PI.digests(PI.find_pii(_t(spark, d, "documents").select("doc_id", "text")))


def op7_toxicity(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "text")
    labels = _t(spark, d, "labels")
    model = TX.fit(TX.training_rows(docs, labels), TX.toxic_share(labels))
    return TX.severity(docs, model).select("doc_id", "toxic_probability", "expected_severity", "grade", "toxic")


def op8_quality_rules(spark, d):
    judged = QR.quality_rules(_t(spark, d, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept")


def op9_simhash_dedup(spark, d):
    return SH.near_duplicates(_t(spark, d, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_decontamination(spark, d):
    return contamination(_t(spark, d, "documents"), _t(spark, d, "benchmark"), ["doc_id"])


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None) -> DataFrame:
    found = DC.decontaminate(docs, benchmark, keep=keep, matches=False)
    return found.select(
        *[F.col(c) for c in found.columns if c != "items"],
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def op11_ranked_search(spark, d):
    return RS.search(_t(spark, d, "documents"), _t(spark, d, "benchmark"))


def op12_jaccard_join(spark, d):
    return JJ.jaccard_join(_t(spark, d, "documents"))


def op13_vector_codes(spark, d):
    return VC.compress(_t(spark, d, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def pipeline(spark, d):
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_packing, op3_chat_format, op4_html_extraction, op5_quality_classifier, op6_pii, op7_toxicity, op8_quality_rules, op9_simhash_dedup, op10_decontamination,
    op11_ranked_search, op12_jaccard_join, op13_vector_codes, pipeline)}
ORACLES: dict[str, str] = {"op1_license_scan": LS.duckdb_sql(), "op3_chat_format": CF.duckdb_sql(), "op8_quality_rules": QR.duckdb_sql(),
                           "op11_ranked_search": RS.duckdb_sql(), "op12_jaccard_join": JJ.duckdb_sql(), "op13_vector_codes": VC.duckdb_sql()}
