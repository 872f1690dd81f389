"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Three stages, each of which groups by digest *and* full content, so two texts
are only ever merged after a comparison of all their bytes:

1. local: the map side of the first aggregation merges equal texts of a task;
2. salted: one digest's remaining rows go to ``salts`` reducers, so a text that
   makes up a third of the corpus never meets in one task;
3. global: the few salt winners of a text (at most ``salts``) are combined.

Full content was compared when the winners were made, and a digest under which
two contents were found raises an error, so the winners can be joined back to
all rows by digest alone. They are written first, so only ids and digests move in
that join, and adaptive execution splits a hot digest there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptloom.llm.common import stash, whole

SALTS = 16


def winners(docs: DataFrame, salts: int = SALTS, text: Column | None = None) -> DataFrame:
    """One row per distinct text: ``digest``, ``keep_id`` (largest doc_id; null only
    if all are null) and ``group_size``. Null texts count as empty."""
    content = whole(F.col("text")) if text is None else text
    rows = docs.select("doc_id", content.alias("content")).select("doc_id", "content", F.sha2("content", 256).alias("digest"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"))
    salted = rows.groupBy("digest", "salt", "content").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("size"))
    merged = salted.groupBy("digest", "content").agg(F.max("keep_id").alias("keep_id"), F.sum("size").alias("size"))
    return merged.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("size").alias("group_size"), F.count(F.lit(1)).alias("contents")).select("digest", F.when(F.col("contents") > 1, F.raise_error(F.lit("two texts share a SHA-256 digest"))).otherwise(F.col("keep_id")).alias("keep_id"), "group_size")


def exact_dedup(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """A row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the largest doc_id of equal texts stays (null ids rank lowest).
    Where rows repeat with that same id and text, one of them is marked kept.
    Null texts count as empty; an empty table gives an empty result; other columns
    of ``docs`` are not read, so their names cannot clash.
    """
    light = docs.select("doc_id", F.sha2(whole(F.col("text")), 256).alias("digest"))
    copies = Window.partitionBy("doc_id", "digest").orderBy("digest")
    light = light.withColumn("copy", F.row_number().over(copies))
    best = stash(winners(docs, salts), "exact-winners")
    return light.join(best, "digest", "left").select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.col("digest").alias("text_sha256")
    )


def keep_one(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, one for each distinct text, with all their columns.

    The same stages carry the other columns of the best row along, so no text is
    shuffled again to fetch them. A text that is null in the row that stays is null.
    """
    others = [c for c in docs.columns if c != "text"]
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)], F.col("text").isNull().alias("absent"))
    rows = docs.select(whole(F.col("text")).alias("content"), F.struct("doc_id").alias("rank"), row.alias("row"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"))
    rows = rows.withColumn("digest", F.sha2("content", 256))
    best = lambda: (F.max_by("row", "rank").alias("row"), F.max("rank").alias("rank"))
    merged = rows.groupBy("digest", "salt", "content").agg(*best()).groupBy("digest", "content").agg(*best())
    back = {"text": F.when(F.col("row.absent"), F.lit(None)).otherwise(F.col("content")), **{c: F.col(f"row.c{i}") for i, c in enumerate(others)}}
    return merged.select(*[back[c].alias(c) for c in docs.columns])
