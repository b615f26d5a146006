"""The pipeline's stages: each takes (spark, docs, sf_dir); all but the last return the columns of docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaframe.llm.decontaminate import contamination
from metaframe.llm.line_dedup import dedup_lines
from metaframe.llm.ngram_join import keep_one_of_each_group
from metaframe.llm.packing import pack_documents
from metaframe.llm.shared import bounded, table
from metaframe.llm.toxicity import THRESHOLD, fit, scored


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose toxicity score is below the threshold; null and empty texts are.

    Repeated rows stay or go together, and an empty table gives one; columns may have any name.
    """
    return scored(docs, fit(docs, table(spark, sf_dir, "labels"))).where(F.col("score") < THRESHOLD).select("row.*")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with one line of each group of near copies, n_chars as it then is. A document that loses all its lines goes.

    Null and empty texts stay. Rows that repeat an id are one document; null ids are one, the least. Columns may
    have any name; n_chars need not be there.
    """
    bounded(spark)
    deduped = dedup_lines(docs).where((F.size("gone") == 0) | (F.length("row.text") > 0))
    size = F.when(F.size("gone") > 0, F.length("row.text").cast("long"))
    return deduped.select(*[(F.coalesce(size, "row.n_chars") if c == "n_chars" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group that the n-gram join links.

    Null and empty texts stay, and so do rows of a null id; rows that repeat an id stay or go together.
    """
    bounded(spark)
    return keep_one_of_each_group(docs)


def without_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not contaminated by the benchmark; null and empty texts are not, and nothing is by an empty benchmark."""
    return contamination(docs, table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' token ids, in sequences of at most 2048. Null texts are empty; repeated rows and null ids are documents like any other."""
    bounded(spark)
    return pack_documents(docs, tokenizer_path())
