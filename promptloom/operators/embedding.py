"""Embedding columns: a text or image column as unit vectors, by a pluggable encoder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.functions.text import for_embedder
from promptloom.shipping import ship

SUFFIX = "_embedding"


class Encoder(Protocol):
    """``dims`` numbers per value. A failure on one value is that value's alone if
    ``encode`` is called with it on its own, which ``embed`` does after a failed batch."""

    dims: int

    def encode(self, values: Sequence[Any]) -> Sequence[Sequence[float]]: ...


class HashEncoder:
    """A deterministic stand-in: the bytes of the MD5, centred. Also states itself as a
    column expression, before scaling to unit length."""

    dims = 16

    def encode(self, values):
        raw = [v if isinstance(v, (bytes, bytearray)) else str(v).encode() for v in values]
        return [[b - 127.5 for b in hashlib.md5(v).digest()] for v in raw]

    def expression(self, value: Column) -> Column:
        places = F.sequence(F.lit(0), F.lit(self.dims - 1))
        return once(F.md5(value.cast("binary")), lambda digits: F.transform(places, lambda i: F.conv(F.substr(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("double") - 127.5))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once for a row, also where ``use`` has it in a
    function that is called for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unit_array(v: Column) -> Column:
    scaled = lambda v, size: F.transform(v, lambda x: F.when(size > 0, x / size).otherwise(0.0))
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return once(v, lambda v: once(size(v), lambda n: scaled(v, n)))


def embed(df: DataFrame, column: str, encoder: Encoder, out: str | None = None) -> DataFrame:
    """``df`` with unit vectors of a column in ``<column>_embedding``. Texts are cut to what
    an encoder reads; null and empty values, and ones that fail, are zero vectors. Equal
    values are encoded once per batch."""
    out = out or f"{column}{SUFFIX}"
    text = df.schema[column].dataType.simpleString() == "string"
    value = for_embedder(F.col(column)) if text else F.col(column)
    blank = value.isNull() | (F.length(value) == 0)
    zero = F.array_repeat(F.lit(0.0), encoder.dims)
    if hasattr(encoder, "expression"):
        return df.withColumn(out, F.when(blank, zero).otherwise(unit_array(encoder.expression(value))).cast("array<float>"))
    ship(df.sparkSession)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            distinct = {bytes(v) if isinstance(v, (bytes, bytearray)) else v for v in values if v is not None and len(v)}
            known = dict(zip(distinct, _vectors(encoder, list(distinct)), strict=True))
            none = np.zeros(encoder.dims, np.float32)
            yield pd.Series([known.get(bytes(v) if isinstance(v, (bytes, bytearray)) else v, none) if v is not None else none for v in values])

    return df.withColumn(out, run.asNondeterministic()(value))


def _vectors(encoder: Encoder, values: list) -> list[np.ndarray]:
    try:
        found = encoder.encode(values)
    except Exception:  # any failure of a user's encoder: find the value that caused it
        if len(values) == 1:
            return [np.zeros(encoder.dims, np.float32)]
        return [v for one in values for v in _vectors(encoder, [one])]
    rows = [np.asarray(v, np.float64) for v in found]
    return [(r / n if (n := np.linalg.norm(r)) > 0 else r * 0).astype(np.float32) for r in rows]
