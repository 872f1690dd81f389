"""Tables written where driver and executors both reach them."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the
    session. Only where that is unset and everything runs in one process (tests) a local
    temporary folder is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        found = f"file://{tempfile.mkdtemp(prefix='promptloom-')}"
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_scopes: list[list[str]] = []


def temporary_path(spark: SparkSession, label: str, outlive: bool = False) -> str:
    """A path of its own in the shared folder, removed like a stash."""
    path = f"{shared_dir(spark)}/stash-{label}-{uuid.uuid4().hex}"
    if _scopes and not outlive:
        _scopes[-1].append(path)
    atexit.register(_remove, spark, path)
    return path


def stash(df: DataFrame, label: str, outlive: bool = False) -> DataFrame:
    """Cut the lineage of ``df``: write it as Parquet under the shared folder and read
    it back. Losing an executor loses nothing of it. Removed at the end of the ``scratch``
    around it (unless it is to ``outlive`` that), or when the driver exits."""
    spark = df.sparkSession
    path = temporary_path(spark, label, outlive)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are removed at the end; what is needed later must outlive it."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _remove(spark, path)


def text_bytes(df: DataFrame) -> int:
    """Bytes of all rows, as text: measured, not estimated."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    return df.agg(F.sum(F.octet_length(row))).first()[0] or 0


def small(df: DataFrame, limit: int) -> bool:
    """Whether the rows of ``df`` have at most ``limit`` bytes, by measure."""
    return text_bytes(df) <= limit


def in_blocks(df: DataFrame, limit: int) -> list[DataFrame]:
    """``df`` in parts of about ``limit`` bytes, by measure; rows that repeat share a part."""
    parts = -(-text_bytes(df) // limit) or 1
    if parts == 1:
        return [df]
    return [df.filter(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(parts)) == i) for i in range(parts)]


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def ranged(df: DataFrame, *order: str, label: str = "ranged", part: str = "__part") -> DataFrame:
    """``df`` dealt by range of ``order``, with each row's range in ``part``. It is written, as
    ranges rest on a sample: two uses of one plan could cut them differently."""
    return stash(df.repartitionByRange(*[F.col(c) for c in order]).withColumn(part, F.spark_partition_id()), label)


def sums_before(df: DataFrame, *order: str, totals: bool = False, **weights: Column | str) -> DataFrame:
    """For each named weight the sum over all rows before a row in the order of ``order``,
    without one task that sees all rows; with ``totals`` also ``<name>_total``."""
    cut = ranged(df, *order)
    amount = {name: F.col(w) if isinstance(w, str) else w for name, w in weights.items()}
    sums = cut.groupBy("__part").agg(*[F.sum(w).alias(f"__sum_{n}") for n, w in amount.items()])
    upto, everything = Window.orderBy("__part"), Window.partitionBy()
    before = sums.select("__part", *[(F.sum(f"__sum_{n}").over(upto) - F.col(f"__sum_{n}")).alias(f"__before_{n}") for n in amount], *[F.sum(f"__sum_{n}").over(everything).alias(f"{n}_total") for n in amount])
    if not totals:
        before = before.drop(*[f"{n}_total" for n in amount])
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = cut.select("*", *[(F.sum(w).over(inside) - w).alias(f"__inside_{n}") for n, w in amount.items()]).join(F.broadcast(before), "__part")  # a row per range
    named = {n: F.col(f"__inside_{n}") + F.col(f"__before_{n}") for n in amount}
    return found.withColumns(named).drop("__part", *[f"__{k}_{n}" for n in amount for k in ("inside", "before")])


def numbered(df: DataFrame, *order: str, out: str, total: str | None = None, weight: str | None = None) -> DataFrame:
    """Consecutive numbers from 0 in the order of ``order`` (with ``weight``, the sum of that
    column over all rows before), without one task that sees all rows. ``total`` names a
    column for the overall number."""
    found = sums_before(df, *order, totals=total is not None, **{out: weight or F.lit(1).cast("long")})
    return found.withColumnRenamed(f"{out}_total", total) if total else found
