"""Semantic operators: a model's reply as a column, predicate, join condition or measure.

Inference is a projection of its own. Prompts are rendered by built-in expressions; equal
prompts are inferred once and joined back (``dedup``); predicates are marked as not
deterministic, so Catalyst keeps chained ones apart and later ones see only the rows
that earlier ones kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.functions import templates as tp
from promptloom.functions.backends import YES_NO, Backend, complete_once
from promptloom.operators.vectors import close_pairs, cosine
from promptloom.shared import in_blocks, stash
from promptloom.shipping import ship


def infer(df: DataFrame, prompt: str, out: str, backend: Backend, choices: Sequence[str] | None = None, choices_col: str | None = None, json_schema: Mapping[str, Any] | None = None, dedup: bool = True, image_col: str | None = None, status: str | None = None) -> DataFrame:
    """``df`` with the reply to each prompt in ``out``. ``choices_col`` holds each row's own
    choices, ``image_col`` its encoded image (a cached embedding, joined by key) for backends
    that take images. Null prompts, and failed requests, have null replies; a column named
    ``status`` tells them apart (ok, failed, no prompt).

    With ``dedup`` the input is read twice, for its distinct prompts and for the join back.
    An input that holds replies of a model itself is therefore written first: each of its
    prompts is asked once, however many operators follow."""
    if status:
        asked = infer(df, prompt, out, backend, choices, choices_col, json_schema, dedup, image_col)
        return asked.withColumn(status, F.when(F.col(out).isNotNull(), "ok").when(F.col(prompt).isNull(), "no prompt").otherwise("failed"))
    options = F.col(choices_col) if choices_col else F.array(*[F.lit(c) for c in choices]) if choices else None
    if hasattr(backend, "expression") and image_col is None:
        return df.withColumn(out, backend.expression(F.col(prompt), options, json_schema))
    ship(df.sparkSession)
    reply = _udf(backend, json_schema)
    options = F.lit(None).cast("array<string>") if options is None else options
    image = F.col(image_col).cast("string") if image_col else F.lit(None).cast("string")
    if not dedup:
        return df.withColumn(out, reply(F.col(prompt), options, image))
    keyed = settled(df).withColumn("__prompt", F.col(prompt)).withColumn("__options", options).withColumn("__image", image)
    asked = ["__prompt", "__options", "__image"]
    # dealt out anew: few bytes of prompts would otherwise be coalesced into one task
    once = keyed.select(*asked).distinct().repartition(df.sparkSession.sparkContext.defaultParallelism, *asked).withColumn(out, reply(*asked))
    a, b = keyed.alias("a"), once.alias("b")
    same = F.lit(True)
    for c in asked:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, same, "left").select(*[F.col(f"a.`{c}`") for c in df.columns if c != out], F.col(f"b.`{out}`"))


def settled(df: DataFrame) -> DataFrame:
    """``df``, written first if reading it would ask a model."""
    conf, key = df.sparkSession.conf, "spark.sql.debug.maxToStringFields"
    before = conf.get(key)
    conf.set(key, str(1 << 20))  # else only the first columns are shown
    try:
        plan = df._jdf.queryExecution().analyzed().toString()
    finally:
        conf.set(key, before)
    return stash(df, "replied") if "model_reply(" in plan else df


def _udf(backend: Backend, json_schema: Mapping[str, Any] | None):
    @F.pandas_udf("string")
    def model_reply(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for prompts, options, images in batches:
            lists = [None if o is None else list(o) for o in options]
            texts = [None if p is None or p != p else p for p in prompts]
            shown = {"images": images.tolist()} if images.notna().any() else {}
            yield pd.Series(backend.complete(texts, lists, json_schema, **shown), dtype=object)

    return model_reply.asNondeterministic()


def sem_map(df: DataFrame, template: str, out: str, backend: Backend, bindings: tp.Bindings | None = None, choices: Sequence[str] | None = None, choices_col: str | None = None, json_schema: Mapping[str, Any] | None = None, system: str | None = None, null_text: str = tp.NULL_TEXT, dedup: bool = True, status: str | None = None) -> DataFrame:
    """A column of replies to a template over each row."""
    asked = df.withColumn("__asked", tp.render(df, template, bindings, null_text, system))
    return infer(asked, "__asked", out, backend, choices, choices_col, json_schema, dedup, status=status).drop("__asked")


def sem_filter(df: DataFrame, template: str, backend: Backend, equals: str = "Yes", bindings: tp.Bindings | None = None, choices: Sequence[str] = YES_NO, dedup: bool = True, **options: Any) -> DataFrame:
    """The rows to which the reply is ``equals``."""
    replied = sem_map(df, template, "__reply", backend, bindings, choices, dedup=dedup, **options)
    return replied.filter(F.col("__reply") == equals).drop("__reply")


def sem_agg(df: DataFrame, by: Sequence[str], template: str, backend: Backend, out: str = "average", choices: Sequence[str] | None = None, bindings: tp.Bindings | None = None, digits: int | None = None, **options: Any) -> DataFrame:
    """The average of numeric replies per group; replies that are no numbers are left out."""
    number = F.avg(F.col("__reply").try_cast("double"))
    replied = sem_map(df, template, "__reply", backend, bindings, choices, **options)
    return replied.groupBy(*by).agg((F.round(number, digits) if digits is not None else number).alias(out))


@dataclass(frozen=True)
class Prefilter:
    """A cheap test of candidate pairs: rows whose embeddings are less similar than
    ``least`` are answered No without inference. A pair without an embedding is asked.
    Without ``keep`` the embeddings are dropped from the pairs."""

    left: str
    right: str
    least: float = 0.2
    keep: bool = True


#: Bytes of the right side of a semantic join without condition that are sent to every executor at once.
BROADCAST_BYTES = 64 << 20


def sem_join(left: DataFrame, right: DataFrame, template: str, backend: Backend, on: Column | None = None, how: str = "inner", prefilter: Prefilter | None = None, bindings: tp.Bindings | None = None, equals: str = "Yes", choices: Sequence[str] = YES_NO, dedup: bool = True) -> DataFrame:
    """Pairs for which the model says ``equals``; ``how`` is inner, left, semi or anti.

    ``on`` and ``prefilter`` are built-in expressions and thin the pairs out before any
    prompt is rendered. Without ``on`` every pair is a candidate, as the operator is
    defined; the right side is broadcast in blocks of measured size. The other kinds
    of join are the inner matches joined back by row key: Spark takes no Python
    predicate in an outer join. Left rows that repeat are paired once, and each of them
    gets the matches.
    """
    if how not in ("inner", "left", "semi", "anti"):
        raise ValueError(f"unknown kind of join: {how}")
    if clash := set(left.columns) & set(right.columns):
        raise ValueError(f"both sides have columns {sorted(clash)}; rename them")
    keyed = left if how == "inner" else settled(left).withColumn("__row", row_key(left))
    once = left if how == "inner" else keyed.dropDuplicates(["__row"])
    if on is None:
        right = settled(right)
        pairs = reduce(DataFrame.unionByName, [_met(once, block, prefilter) for block in in_blocks(right, BROADCAST_BYTES)])
    else:
        pairs = once.join(right, on)
    if prefilter and on is not None:
        close = cosine(F.col(prefilter.left), F.col(prefilter.right))
        pairs = pairs.filter(F.col(prefilter.left).isNull() | F.col(prefilter.right).isNull() | (F.size(prefilter.left) == 0) | (F.size(prefilter.right) == 0) | (close >= prefilter.least))
        pairs = pairs if prefilter.keep else pairs.drop(prefilter.left, prefilter.right)
    matches = sem_filter(pairs, template, backend, equals, bindings, choices, dedup)
    if how == "inner":
        return matches
    if how in ("semi", "anti"):
        return keyed.join(matches.select("__row").distinct(), "__row", f"left_{how}").drop("__row")
    found = matches.select("__row", *[c for c in right.columns if c in matches.columns])
    return keyed.join(found, "__row", "left").drop("__row")


def _met(left: DataFrame, block: DataFrame, prefilter: Prefilter | None) -> DataFrame:
    """All rows with a block of the right side, or the close ones of these pairs."""
    if prefilter is None:
        return left.crossJoin(F.broadcast(block))
    own = prefilter.left in left.columns
    vecs = (prefilter.left, prefilter.right) if own else (prefilter.right, prefilter.left)
    return close_pairs(left, block, *vecs, prefilter.least, prefilter.keep)


def row_key(df: DataFrame) -> Column:
    """A digest of all cells: rows that are equal share it, and so share their matches."""
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}), 256)


@dataclass
class Step:
    """A predicate of a cascade: a built-in condition, or a template that must be answered
    ``equals``. ``cost`` is relative; ``keeps`` is the share of rows expected to pass."""

    template: str | None = None
    condition: Column | None = None
    equals: str = "Yes"
    choices: Sequence[str] = YES_NO
    bindings: tp.Bindings | None = None
    cost: float = 1.0
    keeps: float | None = None
    name: str = field(default="")


def plan_cascade(df: DataFrame, steps: Sequence[Step], backend: Backend, sample_rows: int = 0) -> list[Step]:
    """The steps in the order that costs least: built-in conditions first, then templates by
    cost over the share they remove. Shares not given are measured on ``sample_rows``
    rows, or taken as a half. The result of the cascade does not depend on the order."""
    cheap = [s for s in steps if s.condition is not None]
    asked = [s for s in steps if s.condition is None]
    base = df
    for s in cheap:
        base = base.filter(s.condition)
    sample = base.limit(sample_rows) if sample_rows else None
    n = sample.count() if sample is not None else 0

    def share(s: Step) -> float:
        if s.keeps is not None or not n:
            return 0.5 if s.keeps is None else s.keeps
        return sem_filter(sample, s.template, backend, s.equals, s.bindings, s.choices).count() / n

    return cheap + sorted(asked, key=lambda s: s.cost / max(1e-9, 1 - min(share(s), 1 - 1e-9)))


def cascade(df: DataFrame, steps: Sequence[Step], backend: Backend, reorder: bool = True, sample_rows: int = 0, dedup: bool = True) -> DataFrame:
    """Rows that pass all steps; each step only asks about rows that the earlier ones kept.
    ``reorder=False`` keeps the written order of the templates."""
    ordered = plan_cascade(df, steps, backend, sample_rows) if reorder else list(steps)
    for s in ordered:
        df = df.filter(s.condition) if s.condition is not None else sem_filter(df, s.template, backend, s.equals, s.bindings, s.choices, dedup)
    return df


def register_llm(spark: SparkSession, backend: Backend, name: str = "LLM", choices: Sequence[str] | None = None, json_schema: Mapping[str, Any] | None = None, null_text: str = tp.NULL_TEXT) -> None:
    """Make ``name`` a SQL function: LLM(template, …) -> STRING. Equal prompts of one task are
    asked once, in requests for whole batches; failed ones may be asked again.

    Fields are bound by name with named arguments (``question => c_name``) or one
    struct; plain arguments bind to the fields in template order, and their number must
    fit. A template may be written as several leading strings. The template is read per
    row, and an image argument is rendered as a mark.
    """
    ship(spark)
    lists = list(choices) if choices else None

    known: dict[str, str] = {}  # empty when it is sent: each task fills its own

    @F.pandas_udf("string")
    def llm(template: pd.Series, *args: pd.Series, **named: pd.Series) -> pd.Series:
        prompts = rendered_rows(template, args, named, null_text)
        return pd.Series(complete_once(backend, prompts, lists, json_schema, known), dtype=object)

    spark.udf.register(name, llm.asNondeterministic())


def rendered_rows(template: pd.Series, args: Sequence[Any], named: Mapping[str, Any], null_text: str) -> list[str]:
    """Finished prompts of a batch of SQL calls."""
    if not len(template):
        return []
    if len(args) == 1 and isinstance(args[0], pd.DataFrame):
        named, args = {**{c: args[0][c] for c in args[0].columns}, **named}, ()
    parts, args = [template], list(args)
    found = lambda: tp.places("".join(str(p.iloc[0]) for p in parts))
    # further leading strings belong to the template until it has its fields
    while args and not named and len(found()) != len(args) and (not found() or tp.FIELD.search(str(args[0].iloc[0]))):
        parts.append(args.pop(0))
    texts = [("".join(map(str, row))) for row in zip(*parts, strict=True)]
    places = tp.places(texts[0])
    if named:
        if missing := set(places) - set(named):
            raise ValueError(f"no argument for fields {sorted(missing)}")
        columns = {n: _cells(named[n]) for n in set(places)}
    else:
        if len(places) != len(args):
            raise ValueError(f"the template has {len(places)} fields, the call has {len(args)} arguments")
        columns = {n: _cells(a) for n, a in zip(places, args, strict=True)}

    def value(name: str, i: int) -> str:
        v = columns[name][i]
        return null_text if v is None or v != v else str(v)

    return [tp.FIELD.sub(lambda m, i=i: tp.IMAGE if m[1] == "image" else value(m[2], i), text) for i, text in enumerate(texts)]


def _cells(series: Any) -> list:
    return series.to_dict("records") if isinstance(series, pd.DataFrame) else series.tolist()
