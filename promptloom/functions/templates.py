"""Prompt templates: fields, and rendering as JVM-side column expressions.

A template names its fields as {text:name}, {image:name} or plain {name} (text). The
DataFrame API binds columns to fields by name and renders the prompt with built-in
functions, so a model backend only ever sees one finished prompt column.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELD = re.compile(r"\{(?:(text|image):)?(\w+)\}")
#: What a null cell is rendered as.
NULL_TEXT = "None"
IMAGE = "[image]"

#: The default system prompt and the wording of the JSON render modes.
SYSTEM_PROMPT = (
    "You are a helpful data analyst. You will receive JSON data containing various fields and their corresponding values, "
    "representing different attributes. Use these fields to provide an answer to the user query. The user query will indicate "
    "which fields to use for your response. Your response should contain only the answer and no additional formatting."
)
JSON_PROMPT = "Given the following data:\n {data} \n answer the below query:\n{query}"
JSON_ROW_PROMPT = "Answer the below query:\n\n{query}\n\ngiven the following data:\n\n{data}"
#: Instructions by kind of question, and the kinds they belong to.
REMEMBER_BINARY = "\n\nREMEMBER: Your entire answer must be EXACTLY 'Yes' or 'No' - nothing more, nothing less."
REMEMBER_LETTERS = "\n\nREMEMBER: Your entire answer must be ONLY the letter(s) of the correct option(s) - e.g., 'A' or 'B,D'."
REMEMBER_CONCISE = "\n\nREMEMBER: Your answer must be concise and direct, with no explanatory text."
REMEMBER_UNANSWERABLE = (
    "\n\nREMEMBER: Decide if the question is unanswerable based on the figure and caption. If it is, respond with "
    "'It is not possible to answer this question based only on the provided data.'. If it is not, respond with the correct answer."
)
BINARY_KINDS = ("closed-ended finite answer set binary visual", "closed-ended finite answer set binary non-visual")
CHOICE_KINDS = ("closed-ended finite answer set non-binary visual", "closed-ended finite answer set non-binary non-visual")
OPEN_KINDS = ("closed-ended infinite answer set visual", "closed-ended infinite answer set non-visual")

Bindings = Mapping[str, str | Column]


def fields(template: str) -> list[tuple[str, str]]:
    """(name, kind) of the template's fields in order, each name once."""
    found: dict[str, str] = {}
    for kind, name in FIELD.findall(template):
        found.setdefault(name, kind or "text")
    return list(found.items())


def places(template: str) -> list[str]:
    """Field names in order with repetitions: what positional arguments bind to."""
    return [name for _, name in FIELD.findall(template)]


def join_parts(parts: Sequence[str]) -> str:
    """A template written as several string literals."""
    return "".join(parts)


def bind(df: DataFrame, template: str, bindings: Bindings | None) -> dict[str, Column]:
    """Columns by field name; a field without a binding takes the column of its name.
    Unknown fields and unused bindings are errors."""
    names = [n for n, _ in fields(template)]
    given = dict(bindings or {})
    if unused := set(given) - set(names):
        raise ValueError(f"the template has no field {sorted(unused)}")
    out: dict[str, Column] = {}
    for n in names:
        c = given.get(n, n)
        if isinstance(c, str):
            if c.split(".")[0] not in df.columns and c not in df.columns:
                raise ValueError(f"no column for field {n!r}")
            c = F.col(c)
        out[n] = c
    return out


def cell(df: DataFrame, column: Column, null_text: str = NULL_TEXT) -> Column:
    """A cell as prompt text: strings as they are, structs, maps and arrays as JSON."""
    kind = df.select(column.alias("x")).schema["x"].dataType
    text = F.to_json(column) if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)) else column.cast("string")
    return F.coalesce(text, F.lit(null_text))


def render(df: DataFrame, template: str, bindings: Bindings | None = None, null_text: str = NULL_TEXT, system: str | None = None) -> Column:
    """Mode "replace": each text field becomes its cell, each image field ``[image]``."""
    bound, parts, at = bind(df, template, bindings), [], 0
    for m in FIELD.finditer(template):
        if m.start() > at:
            parts.append(F.lit(template[at : m.start()]))
        parts.append(F.lit(IMAGE) if m[1] == "image" else cell(df, bound[m[2]], null_text))
        at = m.end()
    if at < len(template) or not parts:
        parts.append(F.lit(template[at:]))
    return with_system(F.concat(*parts), system)


def render_fields(df: DataFrame, template: str, bindings: Bindings | None = None, order: Sequence[str] | None = None, null_text: str = NULL_TEXT, system: str | None = None) -> Column:
    """Mode "fields": a line ``name: value`` per field, in ``order``; the prose is left out."""
    bound, kinds = bind(df, template, bindings), dict(fields(template))
    lines = [F.concat(F.lit(f"{n}: "), F.lit(IMAGE) if kinds[n] == "image" else cell(df, bound[n], null_text)) for n in (order or list(kinds))]
    return with_system(F.concat_ws("\n", *lines), system)


def render_json(df: DataFrame, query: str, columns: Sequence[str], single_row: bool = False, system: str | None = None) -> Column:
    """Mode "json": the row's cells as a JSON object (nulls as empty texts) around the query."""
    data = F.to_json(F.struct(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in columns]))
    before, after = (JSON_ROW_PROMPT if single_row else JSON_PROMPT).replace("{query}", query).split("{data}")
    return with_system(F.concat(F.lit(before), data, F.lit(after)), system)


def image_lines(name: str, paths: Column) -> Column:
    """One line ``name_1: [image]`` per element of an array of images."""
    return F.array_join(F.transform(F.coalesce(paths, F.array().cast("array<string>")), lambda _, i: F.concat(F.lit(f"{name}_"), (i + 1).cast("string"), F.lit(f": {IMAGE}"))), "\n")


def with_system(prompt: Column, system: str | None) -> Column:
    return F.concat(F.lit(f"{system}\n\n"), prompt) if system else prompt


def instruction(kind: Column, n_options: Column) -> Column:
    """The instruction that a row's kind of question asks for, to append to its prompt; ''
    for other kinds. It depends on that row alone."""
    return (
        F.when(kind.isin(*BINARY_KINDS), REMEMBER_BINARY)
        .when(kind.isin(*CHOICE_KINDS) & (n_options == 4), REMEMBER_LETTERS)
        .when(kind.isin(*OPEN_KINDS), REMEMBER_CONCISE)
        .when(kind == "unanswerable", REMEMBER_UNANSWERABLE)
        .otherwise("")
    )
