"""Readers, writers and small table chores."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptloom.shared import numbered


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A file with one JSON array of rows."""
    reader = spark.read.option("multiLine", True).option("encoding", "UTF-8")
    return (reader.schema(schema) if schema else reader).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = ",") -> DataFrame:
    """With a header; types are inferred only if no schema is given."""
    reader = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path and content of files, as a table to join on the path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def with_file_bytes(df: DataFrame, files: DataFrame, path: str, out: str = "content") -> DataFrame:
    """The bytes of the file each row names; null if there is none. Files are matched by
    name; of several with that name the one that shares the most folders with the row's
    path is taken, then the first by path. No row comes twice."""
    names = path_ends(files.select("path"), "path").groupBy("__end").agg(F.min("path").alias("__path"))
    paths = path_ends(df.select(F.col(path).alias("__named")).distinct(), "__named")
    best = paths.join(names, "__end").groupBy("__named").agg(F.max_by("__path", "__steps").alias("__path"))
    bytes_of = files.groupBy("path").agg(F.first("content").alias(out)).withColumnRenamed("path", "__path")
    found = best.join(bytes_of, "__path").drop("__path")
    return df.join(found, F.col(path) == F.col("__named"), "left").drop("__named")


def path_ends(df: DataFrame, path: str) -> DataFrame:
    """A row for each end of a path, from its file name alone to the whole of it without
    its scheme: ``__end``, and ``__steps``, its number of steps."""
    plain = F.regexp_replace(F.col(path), "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    steps = F.filter(F.split(plain, "/"), lambda s: (s != "") & (s != "."))
    ends = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.struct(k.alias("__steps"), F.array_join(F.slice(steps, -k, k), "/").alias("__end")))
    return df.filter(F.size(steps) > 0).select(path, F.inline(ends))


def from_pandas(spark: SparkSession, pdf: pd.DataFrame, schema: T.StructType | str | None = None) -> DataFrame:
    return spark.createDataFrame(pdf, schema)


def to_pandas(df: DataFrame, limit: int) -> pd.DataFrame:
    """At most ``limit`` rows on the driver."""
    return df.limit(limit).toPandas()


def write_csv(df: DataFrame, path: str, sep: str = ",", single_file: bool = False) -> None:
    """Quotes are doubled. One file only for small reports."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def register_views(**tables: DataFrame) -> None:
    """Temporary views by name."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def table_names(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def read_yaml(path: str) -> dict[str, Any]:
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def clean(df: DataFrame) -> DataFrame:
    """Without index columns (``Unnamed…``), and with null texts empty."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith("Unnamed")]).na.fill("")


def shuffled(df: DataFrame, *keys: str, seed: int = 42) -> DataFrame:
    """All rows in a pseudorandom order that the seed and the key columns fix."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys)


def ordered_split(df: DataFrame, order: Sequence[str], parts: int, out: str = "part") -> DataFrame:
    """Rows numbered into ``parts`` consecutive ranges of equal size, the last with the rest."""
    size = F.greatest(F.lit(1), F.floor(F.col("__n") / parts))
    rows = numbered(df, *order, out="__at", total="__n")
    return rows.withColumn(out, F.least(F.floor(F.col("__at") / size), F.lit(parts - 1)).cast("int")).drop("__at", "__n")
