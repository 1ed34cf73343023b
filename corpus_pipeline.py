"""The stages that turn raw documents into token ids.

Each stage is a function of the session, the documents its predecessor kept, and the folder of the
given tables. ``run`` writes what a stage returns to the folder all machines share, and the next
one reads it from there. All stages but the last return the columns of ``documents``. What a stage
returns is computed when it is written, so stages that hand texts to Python leave the session's
``spark.sql.execution.arrow.maxRecordsPerBatch`` at ``HANDED`` or less.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.llm import bpe, decontaminate, jaccard, line_dedup, quality
from fieldtally.llm.common import BATCH_ROWS, held_out, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Rows that a task of Python is handed at once. Spark's ten thousand, as texts, are held several times over by each task.
HANDED = 500


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled ones vote at least half for quality; a missing text counts as empty.

    Labels are learned from as in the query, from documents that are not held out. Without labels
    all documents stay.
    """
    hand_less(spark)
    learned = ~F.coalesce(held_out(), F.lit(False))
    labels = table(spark, sf_dir, "labels").where(learned).select("doc_id", "quality")
    model = quality.fit(labels.join(docs.where(learned).select("doc_id", "text"), "doc_id"))
    return quality.keep_good(docs, model).select(*columns_of(docs))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines but where each comes first; those of which nothing is left go.

    A document that had no text before stays as it is. ``n_chars`` is of the text that is left.
    """
    found = line_dedup.dedup_lines(docs)
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"\S")
    return counted(found.where(~F.coalesce(emptied, F.lit(False))), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents alike in 80 % of their five-word shingles, the one of smallest id.

    Documents without words, null or empty, are in no group and stay; of rows repeated whole one stays.
    Very long texts are compared whole; an empty table stays empty.
    """
    return jaccard.one_of_each(docs, n=5, percent=80).select(*columns_of(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of benchmark phrases; ``n_chars`` is of the text that is left.

    A null or empty text, an empty table and an empty benchmark change nothing; very long texts are
    searched whole, and repeated rows are treated alike.
    """
    hand_less(spark)
    return counted(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")), docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of the documents that are left, a row each; of a null or empty text none and empty."""
    hand_less(spark)
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def hand_less(spark: SparkSession) -> None:
    before = int(spark.conf.get(BATCH_ROWS))
    spark.conf.set(BATCH_ROWS, min(before, HANDED) if before > 0 else HANDED)


def columns_of(docs: DataFrame) -> list:
    """The columns of ``documents`` that ``docs`` has."""
    return [F.col(c) for c in COLUMNS if c in docs.columns]


def counted(found: DataFrame, docs: DataFrame) -> DataFrame:
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast("long"))
    return found.select(*columns_of(docs))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: SQL can express neither the classifier nor the classes of near duplicates; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of the documents that all stages keep."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
