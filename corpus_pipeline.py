"""The corpus pipeline: stages applied to ``documents`` one after another.

Every stage takes whole texts of all documents its predecessor kept, and its decisions
take effect. What holds for all: null texts count as empty; null ids, langs and sources
are ordinary values; an empty table gives an empty result; further columns, whatever
their names, are left behind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from promptloom.llm import decontam, exact, jaccard, mixing, toxicity
from promptloom.llm.common import DOCUMENT_COLUMNS, read, scratch, stash


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network rejects go. Empty texts are scored too; rows that
    repeat go or stay together. Without labels of both classes all stay."""
    return toxicity.clean_rows(docs.select(*DOCUMENT_COLUMNS), read(spark, sf_dir, "labels"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays: that with the largest doc_id, null ranking
    lowest; of rows that repeat with that id one. Empty and null texts are one group."""
    return exact.keep_one(docs.select(*DOCUMENT_COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays: that with the smallest doc_id
    (for null a hash of the text). Texts without words are linked with nothing. Rows that
    share the id that stays all stay, as they do where rows repeat."""
    return jaccard.keep_one_of_each_group(docs.select(*DOCUMENT_COLUMNS))


def contaminated_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go, rows that repeat together. Texts
    without words stay, and without items all do."""
    return decontam.clean_rows(docs.select(*DOCUMENT_COLUMNS), read(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words of stay, with the number of words taken. Texts
    without words give none and go. Of rows that repeat one stays."""
    return mixing.mixed_rows(docs.select(*DOCUMENT_COLUMNS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_documents),
    ("exact dedup", exact_duplicates),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", contaminated_documents),
    ("mixing to target weights", mixed_sources),
]

#: A trained network and MinHash signatures take part, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(*DOCUMENT_COLUMNS)
    for at, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark):  # what the stage wrote on its way goes when its result is written
            docs = stash(stage(spark, docs, sf_dir), f"pipeline-{at}", outlive=True)
    return STAGES[-1][1](spark, docs, sf_dir)
