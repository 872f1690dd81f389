"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.shared import numbered, scratch, stash, sums_before

__all__ = ["ASCII_LOWER", "ASCII_UPPER", "DOCUMENT_COLUMNS", "WHITE", "WORD", "fold_ascii", "numbered", "read", "scratch", "stash", "sums_before", "whole"]

WHITE = r"\x20\x09-\x0D"
WORD = rf"[^{WHITE}]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()

#: Columns of the documents table, which every pipeline stage but the last returns.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z and leave every other character as it is; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), ASCII_UPPER, ASCII_LOWER)


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))
