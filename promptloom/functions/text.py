"""Scalar helpers around prompts and replies; all are built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EMBEDDER_CHARS = 77


def fold_space(text: Column) -> Column:
    """Line breaks and runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\n\r]+", " "), r"\s+", " "))


def like_any(text: Column, answers: Column) -> Column:
    """Whether any answer, lower-cased and trimmed, is in the text as a LIKE pattern (so that
    % and _ in answers are wildcards)."""
    return F.exists(answers, lambda x: F.like(F.lower(F.trim(text)), F.concat(F.lit("%"), F.lower(F.trim(x)), F.lit("%"))))


def json_answer(reply: Column, key: str = "Answer") -> Column:
    return F.get_json_object(reply, f"$.{key}")


def options(text: Column) -> Column:
    """A list of options from a JSON or Python-style list literal, else from comma-separated
    text; elements are trimmed."""
    literal = F.from_json(F.regexp_replace(text, r"'((?:[^'\\]|\\.)*)'(?=\s*[,\]])", '"$1"'), "array<string>")
    listed = F.when(F.trim(text).startswith("["), literal)
    return F.transform(F.coalesce(listed, F.split(text, ",")), lambda x: F.trim(x))


def answer_index(reply: Column, choices: Column) -> Column:
    """Place of the reply among the options (from 0, case and outer space ignored), -1 if
    it is none of them."""
    tidy = F.transform(choices, lambda x: F.lower(F.trim(x)))
    return F.coalesce(F.array_position(tidy, F.lower(F.trim(reply))).cast("int") - 1, F.lit(-1))


def prepend_name(df: DataFrame, *names: str) -> DataFrame:
    """Each cell as ``name: value`` (all columns unless some are named)."""
    chosen = set(names or df.columns)
    return df.select(*[F.concat(F.lit(f"{c}: "), F.col(f"`{c}`").cast("string")).alias(c) if c in chosen else F.col(f"`{c}`") for c in df.columns])


def unprepend_name(df: DataFrame, *names: str) -> DataFrame:
    """The inverse of ``prepend_name`` on text columns."""
    chosen = set(names or df.columns)
    return df.select(*[F.regexp_replace(F.col(f"`{c}`"), f"(?s)^{c}: ", "").alias(c) if c in chosen else F.col(f"`{c}`") for c in df.columns])


def value_weight(df: DataFrame, name: str) -> Column:
    """Squared length of a cell: of the text for strings and numbers, 16 for booleans (as
    for four letters), 0 for others and null."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.BooleanType):
        size = F.when(c.isNotNull(), 16)
    elif isinstance(kind, (T.StringType, T.NumericType)):
        size = F.pow(F.length(c.cast("string")), 2)
    else:
        size = F.lit(0)
    return F.coalesce(size.cast("long"), F.lit(0))


def combine(*columns: Column, sep: str = " ") -> Column:
    """Columns as text, joined; null and empty ones are skipped."""
    return F.concat_ws(sep, *[F.nullif(c.cast("string"), F.lit("")) for c in columns])


def flatten_text(df: DataFrame, name: str) -> Column:
    """A cell as text: arrays space-joined, null as the empty text."""
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, T.ArrayType):
        c = F.array_join(c.cast("array<string>"), " ")
    return F.coalesce(c.cast("string"), F.lit(""))


def image_bytes(df: DataFrame, name: str) -> Column:
    """The bytes of an image cell: binary, struct with bytes or content, or an array of
    those (its first element). Paths give null; join a binary-file scan for them."""
    return _bytes(F.col(f"`{name}`"), df.schema[name].dataType)


def _bytes(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType):
        return _bytes(F.get(c, F.lit(0)), kind.elementType)
    if isinstance(kind, T.StructType):
        held = [_bytes(c[n], kind[n].dataType) for n in ("bytes", "content") if n in kind.names]
        return F.coalesce(*held) if held else F.lit(None).cast("binary")
    return c if isinstance(kind, T.BinaryType) else F.lit(None).cast("binary")


def image_path(df: DataFrame, name: str) -> Column:
    """The path of an image cell: text, struct with path, or an array of those (the first)."""
    return _path(F.col(f"`{name}`"), df.schema[name].dataType)


def _path(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType):
        return _path(F.get(c, F.lit(0)), kind.elementType)
    if isinstance(kind, T.StructType):
        return _path(c["path"], kind["path"].dataType) if "path" in kind.names else F.lit(None).cast("string")
    return c if isinstance(kind, T.StringType) else F.lit(None).cast("string")


def for_embedder(text: Column) -> Column:
    return F.substring(text, 1, EMBEDDER_CHARS)


def stats_text(df: DataFrame, name: str) -> Column:
    """A cell as text for statistics: nested values as JSON. The original stays in its column."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    return F.to_json(c) if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)) else c.cast("string")
