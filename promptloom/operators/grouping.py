"""Encode once per key: group the rows that share an image, do the costly step once, and
join its result back; with the statistics that tell whether this pays."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.shared import numbered
from promptloom.shipping import ship

#: Fixed value: how the questions on one image are put to the encoder.
GUIDANCE = "Extract the image's key information based on the below questions: "


def redundancy(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("redundancy"))


def redundancy_summary(df: DataFrame, key: str) -> DataFrame:
    return redundancy(df, key).agg(F.sum("redundancy").alias("rows"), F.count(F.lit(1)).alias("keys"), F.avg("redundancy").alias("average"))


def guidance(df: DataFrame, key: str, question: str, order: str) -> DataFrame:
    """All questions on a key in one text, in the order of ``order``."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(question))))
    quoted = F.transform(listed, lambda s: F.concat(F.lit('"'), s[question], F.lit('"')))
    return df.groupBy(key).agg(F.concat(F.lit(GUIDANCE), F.array_join(quoted, ", ")).alias("guidance"), F.count(F.lit(1)).alias("questions"))


def key_ids(df: DataFrame, key: str, out: str = "key_id", dense: bool = False) -> DataFrame:
    """Ids of distinct keys: a digest, or with ``dense`` the rank of the key. Ranks are made
    over the distinct keys and joined back, so rows are never sorted as a whole."""
    if not dense:
        return df.withColumn(out, F.xxhash64(key))
    ranks = numbered(df.select(key).distinct(), key, out=out).withColumn(out, (F.col(out) + 1).cast("int"))
    a, b = df.alias("a"), ranks.alias("b")
    return a.join(b, F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}"))).select("a.*", out)


def top_keys(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    return redundancy(df, key).orderBy(F.desc("redundancy"), key).limit(n)


def encode_once(df: DataFrame, key: str, encode: Callable[[Any], Any], value: str, kind: str, out: str = "encoded") -> DataFrame:
    """``encode`` applied to one value of each key, joined back to all rows. A failure makes
    that key's result null and its ``status`` say so; other keys are not touched."""
    ship(df.sparkSession)

    @F.pandas_udf(f"result {kind}, status string")
    def run(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            try:
                rows.append((encode(v), "ok"))
            except Exception as e:  # any failure of a user's encoder is that key's alone
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["result", "status"])

    once = df.groupBy(key).agg(F.first(value, ignorenulls=True).alias("__v")).withColumn("__e", run.asNondeterministic()("__v"))
    a, b = df.alias("a"), once.alias("b")
    return a.join(b, F.col(f"a.`{key}`").eqNullSafe(F.col(f"b.`{key}`")), "left").select("a.*", F.col("b.__e.result").alias(out), F.col("b.__e.status").alias("status"))


def lookup(df: DataFrame, cache: DataFrame, key: str, value: str, default: Column | None = None) -> DataFrame:
    """A cached value by key; ``default`` for keys that are not cached."""
    a, b = df.alias("a"), cache.select(key, value).alias("b")
    found = F.col(f"b.`{value}`")
    return a.join(b, F.col(f"a.`{key}`") == F.col(f"b.`{key}`"), "left").select("a.*", (found if default is None else F.coalesce(found, default)).alias(value))
