"""A training corpus from documents: quality, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; all but the last return the columns of documents. run() writes each
stage's result as Parquet to the shared folder and reads it for the next one.

In every stage null texts count as empty, rows that repeat a doc_id are judged
each by their own text (line dedup: by common line numbers), rows with a null
doc_id stay, an empty table gives an empty table, and further columns may have
any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import decontaminate, linededup, nearcopies, packing, quality
from tideline.llm.common import read, saved
from tideline.llm.queries import vocabulary


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose grade is likely 1 or more; the model is fitted on the labels of these documents.

    A doc_id goes if one of its rows is rejected; empty texts are graded like others.
    """
    return quality.selected(docs, quality.fit(docs, read(spark, sf_dir, "labels"), folds_out=None))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier line; n_chars follows the text.

    Documents without lines left stay, empty; null texts stay null.
    """
    return linededup.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 or more over 5-word shingles the document with the smallest doc_id.

    SimHash links by blocks first, each decided on the whole sets; MinHash bands find
    the pairs beyond three bits. Empty and null texts are one group.
    """
    return nearcopies.kept(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found; empty texts hold none."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents packed into sequences of at most 2048 tokens; an empty or null text is one piece with the end id."""
    return packing.packed(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: A learned classifier and tokenizer ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
