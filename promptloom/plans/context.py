"""Multi-source context assembly: a question with the texts, images and table it refers
to, gathered by id into one prompt row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts of the assembled prompt.
SEPARATOR = "\n\n--- Document Separator ---\n\n"
NO_TEXT = "No context documents available."
NO_TABLE = "No table data available."
CONTEXT_TEMPLATE = """
Given the following question, context documents, table data, and images, please provide a comprehensive answer.

Question: {text:question}

Context Documents:
{text:all_text_docs}

Table Data:
{text:table_data}

Image Data:
{image:image_paths}

Please analyze all the provided information and answer the question thoroughly.
"""


def _gathered(questions: DataFrame, ids: str, source: DataFrame, value: str, out: str) -> DataFrame:
    """Per question the values that its ids refer to, in the order of the ids."""
    each = questions.select("qid", F.posexplode(ids).alias("at", "ref"))
    found = each.join(source.select(F.col("id").alias("ref"), F.col(value).alias("v")), "ref").filter(F.col("v").isNotNull())
    listed = F.array_sort(F.collect_list(F.struct("at", "v")))
    return found.groupBy("qid").agg(F.transform(listed, lambda s: s["v"]).alias(out))


def assemble(questions: DataFrame, texts: DataFrame, images: DataFrame, tables: DataFrame) -> DataFrame:
    """qid, question, all_text_docs, table_data, image_paths for every question.

    questions: qid, question, text_doc_ids, image_doc_ids, table_id; texts: id, text;
    images: id, path; tables: id, table_json. A question without ids, or whose ids lead
    nowhere, keeps its row with the stated fallbacks and no images.
    """
    with_texts = questions.select("qid", "question", "table_id").join(_gathered(questions, "text_doc_ids", texts, "text", "docs"), "qid", "left")
    with_images = with_texts.join(_gathered(questions, "image_doc_ids", images, "path", "paths"), "qid", "left")
    full = with_images.join(tables.select(F.col("id").alias("table_id"), "table_json"), "table_id", "left")
    return full.select(
        "qid", "question",
        F.coalesce(F.nullif(F.array_join("docs", SEPARATOR), F.lit("")), F.lit(NO_TEXT)).alias("all_text_docs"),
        F.coalesce("table_json", F.lit(NO_TABLE)).alias("table_data"),
        F.coalesce("paths", F.array().cast("array<string>")).alias("image_paths"),
    )
