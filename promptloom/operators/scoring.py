"""Scoring replies and reporting runs; everything is one or two aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.functions.text import answer_index, json_answer, like_any
from promptloom.shared import numbered


def _flag(c: Column) -> Column:
    return F.when(c, 1).otherwise(0)


def exact(reply: Column, answer: Column) -> Column:
    return _flag(F.lower(F.trim(reply)) == F.lower(F.trim(answer)))


def contains(reply: Column, answer: Column) -> Column:
    """Whether the reply contains the answer (true for empty answers)."""
    return _flag(F.lower(reply).contains(F.lower(F.trim(answer))))


def any_answer(reply: Column, answers: Column, key: str | None = "Answer") -> Column:
    """Whether the reply (its JSON field, if named) matches any of the answers."""
    text = reply if key is None else json_answer(reply, key)
    return _flag(like_any(text, answers))


def by_index(reply: Column, options: Column, answer: Column) -> Column:
    """Whether the answer, a place in the options, is where the reply is or what it says."""
    return _flag((reply == answer.cast("string")) | (answer_index(reply, options) == answer.cast("int")))


def accuracy(df: DataFrame, flag: str = "is_correct", by: Sequence[str] = ()) -> DataFrame:
    """Rows, correct rows and accuracy in percent (0 for no rows)."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(flag), F.lit(0)).alias("correct"), F.coalesce(F.avg(flag) * 100, F.lit(0.0)).alias("accuracy"))


def accuracy_with_total(df: DataFrame, by: str, flag: str = "is_correct") -> DataFrame:
    """Accuracy per value of ``by`` (a file, say) and overall, in the row ``total``."""
    rows = df.rollup(by).agg(F.grouping(by).alias("g"), F.count(F.lit(1)).alias("n"), F.sum(flag).alias("correct"))
    return rows.select(F.when(F.col("g") == 1, F.lit("total")).otherwise(F.col(by).cast("string")).alias(by), "n", "correct", (F.col("correct") * 100 / F.col("n")).alias("accuracy"))


def confusion(df: DataFrame, answer: str, reply: str) -> DataFrame:
    return df.groupBy(F.lower(F.trim(answer)).alias("answer"), F.lower(F.trim(reply)).alias("predicted")).count()


def mme(df: DataFrame, question_id: str = "question_id", answer: str = "answer", reply: str = "predicted") -> DataFrame:
    """One row: accuracy, share of images with all answers right, their sum in percent, and
    the yes/no counts with precision and recall. The image is the id up to a comma."""
    a, p = F.lower(F.trim(answer)), F.lower(F.trim(reply))
    rows = df.select(F.substring_index(F.col(question_id).cast("string"), ",", 1).alias("image"), a.alias("a"), F.coalesce(p, F.lit("")).alias("p"))
    right = F.col("a") == F.col("p")
    pair = lambda x, y: F.count_if((F.col("a") == x) & (F.col("p") == y))
    images = rows.groupBy("image").agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("ok"), F.bool_and(F.coalesce(right, F.lit(False))).alias("all"), pair("yes", "yes").alias("tp"), pair("no", "no").alias("tn"), pair("no", "yes").alias("fp"), pair("yes", "no").alias("fn"))
    total = images.agg(F.count(F.lit(1)).alias("images"), F.sum("n").alias("questions"), F.sum("ok").alias("correct"), F.count_if("all").alias("images_correct"), *[F.sum(c).alias(c) for c in ("tp", "tn", "fp", "fn")])
    acc, plus = F.col("correct") / F.col("questions"), F.col("images_correct") / F.col("images")
    share = lambda x, y: F.coalesce(F.col(x) / F.nullif(F.col(x) + F.col(y), F.lit(0)), F.lit(0.0))
    return total.select("images", "questions", "correct", "images_correct", "tp", "tn", "fp", "fn", (acc * 100).alias("accuracy"), (plus * 100).alias("accuracy_plus"), ((acc + plus) * 100).alias("score"), share("tp", "fp").alias("precision"), share("tp", "fn").alias("recall"))


def quantiles(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """``by`` and ``q``, the exact quantiles (interpolated) of ``value`` in each group. Values
    are counted and numbered by range over the whole table, so that neither a large
    group nor its distinct values have to fit one task's memory."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__c"))
    placed = numbered(counts, *by, value, out="__at", weight="__c")
    totals = placed.groupBy(*by).agg(F.min("__at").alias("__base"), F.sum("__c").alias("__n")).select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], "__base", "__n")
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    rows = placed.join(totals, same) if by else placed.crossJoin(F.broadcast(totals))  # a single row
    start = F.col("__at") - F.col("__base")
    at = lambda p: F.max(F.when((start <= p) & (p < start + F.col("__c")), F.col(value)))
    ends = []
    for i, share in enumerate(shares):
        place = (F.col("__n") - 1) * F.lit(float(share))
        ends += [at(F.floor(place)).alias(f"__lo{i}"), at(F.ceil(place)).alias(f"__hi{i}"), F.max(place - F.floor(place)).alias(f"__part{i}")]
    found = rows.groupBy(*by).agg(*ends)
    between = lambda i: F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * F.col(f"__part{i}")
    return found.select(*by, F.array(*[between(i) for i in range(len(shares))]).alias("q"))


def timing_summary(df: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """mean, median, min, max and sum of each metric, a row per group and metric."""
    long = df.select(*by, F.posexplode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("at", "s")).select(*by, "s.metric", "s.v")
    sums = long.groupBy(*by, "metric").agg(F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), F.sum("v").alias("sum")).alias("s")
    middle = quantiles(long, [*by, "metric"], "v", [0.5]).alias("m")
    same = F.col("s.metric") == F.col("m.metric")
    for c in by:
        same = same & F.col(f"s.`{c}`").eqNullSafe(F.col(f"m.`{c}`"))
    return sums.join(middle, same, "left").select(*[F.col(f"s.`{c}`") for c in by], "s.metric", "s.mean", F.col("m.q")[0].alias("median"), "s.min", "s.max", "s.sum")


def best_run(df: DataFrame, run: str, score: str) -> DataFrame:
    """The run with the best score; ties go to the first name."""
    return df.orderBy(F.desc(score), run).limit(1)


def sweep(df: DataFrame, by: str, flag: str, total: str, part: str) -> DataFrame:
    """Per setting: accuracy, total time, time of one phase and its share."""
    return df.groupBy(by).agg((F.avg(flag) * 100).alias("accuracy"), F.sum(total).alias("total_time"), F.sum(part).alias("part_time"), (F.sum(part) * 100 / F.sum(total)).alias("part_share"))


def cdf(df: DataFrame, value: str) -> DataFrame:
    """The empirical distribution: i / n for each value in order; nulls and NaN are left out.

    Values are counted first and numbered by range. Equal values keep their own steps, as
    many rows as they occur.
    """
    v = F.col(value).cast("double")
    counts = df.select(v.alias("value")).filter(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("value").agg(F.count(F.lit(1)).alias("c"))
    upto = numbered(counts, "value", out="before", total="n", weight="c")
    return upto.select("value", F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("c"))).alias("i"), "n").select("value", (F.col("i") / F.col("n")).alias("share"))


def outlier_share(df: DataFrame, value: str) -> DataFrame:
    """Share of values over Q3 + 1.5 IQR, with exact percentiles."""
    numbers = df.select(F.col(value).cast("double").alias("v"))
    q = quantiles(numbers, [], "v", [0.25, 0.75]).select((F.col("q")[1] + 1.5 * (F.col("q")[1] - F.col("q")[0])).alias("fence"))
    return df.crossJoin(F.broadcast(q)).agg(F.avg(F.when(F.col(value) > F.col("fence"), 1.0).otherwise(0.0)).alias("ratio"))


def describe(df: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """min, max, mean and median of each metric, to compare data sets."""
    return timing_summary(df, metrics, by).select(*by, "metric", "min", "max", "mean", "median")
