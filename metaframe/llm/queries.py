"""One query for each operator, over its whole table, and SQL where it can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaframe.llm import sql, toxicity
from metaframe.llm.chat import format_turns, read_back
from metaframe.llm.decontaminate import contamination
from metaframe.llm.html_extract import main_text
from metaframe.llm.line_dedup import dedup_lines
from metaframe.llm.lm import lm_scores
from metaframe.llm.ngram_join import ngram_groups
from metaframe.llm.packing import pack_documents
from metaframe.llm.quality import quality
from metaframe.llm.shared import table
from metaframe.llm.stages import tokenizer_path
from metaframe.llm.warc import archived


def op1_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_groups(table(spark, sf_dir, "documents"))


def op3_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    return read_back(format_turns(rows.unionByName(trap), tokenizer_path()), tokenizer_path())


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = toxicity.scored(docs.select("doc_id", "text"), toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scores.select("row.doc_id", toxicity.held_out("row.doc_id").alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (the lines' numbers, from 0) and the digest of the text that stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs.withColumn("n_lines", F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long")))
    return out.select("row.doc_id", "row.n_lines", F.size("gone").cast("long").alias("n_removed"), F.col("gone").alias("removed"), F.sha2(F.coalesce("row.text", F.lit("")), 256).alias("text_sha256"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc_archive,
        op2_ngram_jaccard_join,
        op3_harmonic_packing,
        op4_chat_format,
        op5_toxicity,
        op6_html_extraction,
        op7_quality_rules,
        op8_decontamination,
        op9_line_dedup,
        op10_lm_scoring,
    )
}

SQL: dict[str, str] = {
    "op1_warc_archive": sql.WARC,
    "op2_ngram_jaccard_join": sql.NGRAM_JOIN,
    "op4_chat_format": sql.CHAT,
    "op6_html_extraction": sql.HTML,
    "op7_quality_rules": sql.QUALITY,
    "op8_decontamination": sql.DECONTAMINATION,
}
