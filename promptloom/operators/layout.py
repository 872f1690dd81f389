"""Table layout for prompt prefix reuse: statistics, column and row order, and exact
measures of how much of consecutive prompts a prefix cache could reuse.

What a run needs in practice is the column order, which one aggregation gives, and rows
sorted so that equal prefixes meet. The greedy reordering, in which every row gets its
own cell order, runs per chunk of rows under ``applyInPandas``; its cells are structs
(name, value), since a column name no longer describes them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptloom.functions.text import stats_text
from promptloom.shared import ranged
from promptloom.shipping import ship

CHUNK_ROWS = 2000
#: Dollars per million tokens without and with a cache hit, characters a token.
UNCACHED, CACHED, CHARS_PER_TOKEN = 2.5, 1.25, 5


def _text(df: DataFrame, name: str) -> Column:
    return F.coalesce(stats_text(df, name), F.lit(""))


def column_stats(df: DataFrame, *names: str) -> DataFrame:
    """A row per column, from one pass: rows, distinct values, mean squared length and the
    score squared length * (rows / distinct - 1), 0 if all values differ."""
    chosen = list(names or df.columns)
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("column"), _text(df, c).alias("v")) for i, c in enumerate(chosen)])).alias("s")).select("s.*")
    per_value = cells.groupBy("place", "column", "v").agg(F.count(F.lit(1)).alias("c"))
    stats = per_value.groupBy("place", "column").agg(F.sum("c").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"), (F.sum(F.col("c") * F.length("v") * F.length("v")) / F.sum("c")).alias("mean_len2"), (F.sum(F.col("c") * F.length("v")) / F.sum("c")).alias("mean_len"))
    return stats.select("place", "column", "n_rows", "n_distinct", "mean_len2", (F.col("mean_len2") * (F.col("n_rows") / F.col("n_distinct") - 1)).alias("score"), (F.col("mean_len") / F.col("n_distinct")).alias("len_per_value"))


def column_order(df: DataFrame, *names: str, discard: float = 1.0) -> list[str]:
    """Columns by score, best first (ties in their order); those with more than ``discard`` of
    the rows distinct come last, by score among themselves."""
    rows = column_stats(df, *names).collect()  # one row per column
    if not rows:  # an empty table
        return list(names or df.columns)
    rank = lambda r: (r["n_distinct"] > r["n_rows"] * discard, -r["score"], r["place"])
    return [r["column"] for r in sorted(rows, key=rank)]


def fixed_reorder(df: DataFrame, *names: str, discard: float = 1.0, partitions: int | None = None) -> DataFrame:
    """Columns by score and rows in their lexicographic order. With ``partitions`` the rows
    are dealt by range and sorted in each, without one global merge."""
    order = column_order(df, *names, discard=discard)
    shown = df.select(*[F.col(f"`{c}`") for c in order])
    keys = [F.col(f"`{c}`") for c in order]
    return shown.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys) if partitions else shown.orderBy(*keys)


def value_groups(df: DataFrame, *names: str) -> DataFrame:
    """How often each value occurs in any cell."""
    cells = df.select(F.explode(F.array(*[_text(df, c) for c in (names or df.columns)])).alias("value"))
    return cells.groupBy("value").agg(F.count(F.lit(1)).alias("cells"))


def dependencies(df: DataFrame, *names: str, threshold: float = 1.0) -> DataFrame:
    """Pairs of columns (a, b) that determine each other: the share of values of either with
    exactly one partner value reaches ``threshold`` both ways. Nulls are left out pairwise."""
    chosen = list(names or df.columns)
    pairs = [(a, b) for i, a in enumerate(chosen) for b in chosen[i + 1 :]]
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), stats_text(df, a).alias("x"), stats_text(df, b).alias("y")) for a, b in pairs])).alias("s")).select("s.*").filter("x is not null and y is not null").distinct()

    def share(key: str) -> DataFrame:
        per = cells.groupBy("a", "b", key).agg(F.count(F.lit(1)).alias("partners"))
        return per.groupBy("a", "b").agg(F.avg(F.when(F.col("partners") == 1, 1.0).otherwise(0.0)).alias(f"share_{key}"))

    return share("x").join(share("y"), ["a", "b"]).filter((F.col("share_x") >= threshold) & (F.col("share_y") >= threshold)).select("a", "b", F.col("share_x").alias("forward"), F.col("share_y").alias("backward"))


def dependency_groups(pairs: Sequence[tuple[str, str]]) -> list[list[str]]:
    """Groups of columns in which all pairs determine each other, larger ones first; each
    column is in one group."""
    near: dict[str, set[str]] = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    groups, left = [], set(near)
    while left:
        best: list[str] = []
        for start in sorted(left):
            group = [start]
            for c in sorted(near[start] & left):
                if all(c in near[g] for g in group):
                    group.append(c)
            best = max(best, group, key=len)
        groups.append(best)
        left -= set(best)
    return [g for g in groups if len(g) > 1]


def merge_columns(df: DataFrame, groups: Sequence[Sequence[str]], sep: str = " ") -> DataFrame:
    """Each group of equally distinct columns as one column of their joined text, named by
    their names with _ between; groups whose numbers of distinct values differ stay."""
    columns = [c for g in groups for c in g]
    if not columns:
        return df
    n = df.agg(*[F.count_distinct(F.col(f"`{c}`")).alias(c) for c in columns]).first()
    merged = {g[0]: F.concat_ws(sep, *[F.col(f"`{c}`").cast("string") for c in g]).alias("_".join(g)) for g in groups if len({n[c] for c in g}) == 1}
    gone = {c for g in groups if g[0] in merged for c in g[1:]}
    return df.select(*[merged.get(c, F.col(f"`{c}`")) for c in df.columns if c not in gone])


def cell_hits(df: DataFrame, *names: str) -> DataFrame:
    """Cells that repeat an earlier row's prefix of cells, for this column order: hits and
    their share, and the same weighted by length**4. Independent of row order: of the rows
    that share a prefix, all but one hit."""
    chosen = list(names or df.columns)
    arr = F.array(*[_text(df, c) for c in chosen])
    prefixes = df.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(len(chosen))), lambda k: F.slice(arr, 1, k))).alias("p"))
    per = prefixes.groupBy("p").agg(F.count(F.lit(1)).alias("c")).withColumn("w", F.pow(F.length(F.element_at("p", -1)).cast("double"), 4))
    sums = per.agg(F.sum("c").alias("cells"), F.sum(F.col("c") - 1).alias("hits"), F.sum(F.col("c") * F.col("w")).alias("weight"), F.sum((F.col("c") - 1) * F.col("w")).alias("weighted_hits"))
    return sums.select("cells", "hits", (F.col("hits") * 100 / F.col("cells")).alias("hit_rate"), "weighted_hits", (F.col("weighted_hits") * 100 / F.nullif(F.col("weight"), F.lit(0.0))).alias("weighted_rate"))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two texts, in characters, by bisection."""
    most = F.least(F.length(a), F.length(b))
    steps = F.sequence(F.lit(30), F.lit(0), F.lit(-1))
    grown = lambda n, bit: n + F.pow(F.lit(2.0), bit).cast("long")
    return F.aggregate(steps, F.lit(0).cast("long"), lambda n, bit: F.when((grown(n, bit) <= most) & (F.substr(a, F.lit(1), grown(n, bit).cast("int")) == F.substr(b, F.lit(1), grown(n, bit).cast("int"))), grown(n, bit)).otherwise(n))


def char_hits(df: DataFrame, prompt: Column) -> DataFrame:
    """Characters of all prompts that an unbounded prefix cache has seen, and their share.

    Equals the sum of common prefixes of neighbours in sorted order. Prompts are dealt by
    range; inside a range a window looks back, and first and last prompts of the ranges,
    two rows a range, settle the borders.
    """
    rows = df.select(F.coalesce(prompt, F.lit("")).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("c"))
    cut = ranged(rows, "p", part="part")
    inside = cut.withColumn("prev", F.lag("p").over(Window.partitionBy("part").orderBy("p")))
    own = F.col("c") * F.length("p")
    body = inside.agg(F.sum(own).alias("chars"), F.sum((F.col("c") - 1) * F.length("p") + F.coalesce(common_prefix(F.col("p"), F.col("prev")), F.lit(0))).alias("hits"))
    edges = cut.groupBy("part").agg(F.min("p").alias("low"), F.max("p").alias("high"))
    border = edges.withColumn("prev", F.lag("high").over(Window.orderBy("part"))).agg(F.coalesce(F.sum(common_prefix(F.col("low"), F.col("prev"))), F.lit(0)).alias("border"))
    total = body.crossJoin(border)
    return total.select("chars", (F.col("hits") + F.col("border")).alias("hits"), ((F.col("hits") + F.col("border")) * 100 / F.nullif(F.col("chars"), F.lit(0))).alias("hit_rate"))


def adjacent_hits(df: DataFrame, prompt: str, pos: str, by: Sequence[str] = ()) -> DataFrame:
    """Characters that each prompt shares with the one before it in the order of ``pos``: what
    a cache that holds one prompt reuses."""
    order = Window.partitionBy(*by).orderBy(pos)
    return df.withColumn("__prev", F.lag(prompt).over(order)).groupBy(*by).agg(F.sum(F.length(prompt)).alias("chars"), F.coalesce(F.sum(common_prefix(F.col(prompt), F.col("__prev"))), F.lit(0)).alias("hits"))


def prompt_cost(hits: DataFrame, uncached: float = UNCACHED, cached: float = CACHED, chars_per_token: float = CHARS_PER_TOKEN) -> DataFrame:
    """Dollars for prompts with ``chars`` characters of which ``hits`` are cached, and without a cache."""
    million = chars_per_token * 1e6
    return hits.select("chars", "hits", (((F.col("chars") - F.col("hits")) * uncached + F.col("hits") * cached) / million).alias("cost"), (F.col("chars") * uncached / million).alias("cost_uncached"))


# ---- greedy reordering inside a chunk: rows are lists of (name, value) cells

Cells = list[tuple[str, str]]


def _weight(value: str) -> int:
    return len(value) ** 2


def _settled(rows: list[tuple[int, Cells]]) -> list[tuple[int, Cells]]:
    """Columns by score, rows in lexicographic order: where grouping does not pay any more."""
    if not rows or not rows[0][1]:
        return sorted(rows, key=lambda r: r[0])
    width = len(rows[0][1])
    score = []
    for j in range(width):
        values = [cells[j][1] for _, cells in rows]
        score.append(sum(map(_weight, values)) / len(values) * (len(values) / len(set(values)) - 1))
    order = sorted(range(width), key=lambda j: (-score[j], j))
    moved = [(pos, [cells[j] for j in order]) for pos, cells in rows]
    return sorted(moved, key=lambda r: ([v for _, v in r[1]], r[0]))


def greedy(rows: list[tuple[int, Cells]], early_stop: float = 0, depends: Mapping[str, Sequence[str]] | None = None) -> list[tuple[int, Cells]]:
    """Rows with their cells, both reordered so that neighbours share long prefixes.

    The value with the most to gain, squared length times repetitions over all cells, is
    chosen; rows that hold it come first with its cells in front (and, with ``depends``,
    cells of columns that depend on those), and both parts are treated alike until
    nothing gains more than ``early_stop``. Ties go to the smaller text and position.
    """
    out: list[tuple[int, Cells]] = []
    work: list[tuple[list[tuple[str, str]], list[tuple[int, Cells, Cells]]]] = [([], [(pos, [], list(cells)) for pos, cells in rows])]
    while work:
        _, part = work.pop()
        counts = Counter(v for _, _, rest in part for v in {v for _, v in rest})
        value, gain = None, early_stop
        for v in sorted(counts):
            if (g := _weight(v) * (counts[v] - 1)) > gain:
                value, gain = v, g
        if value is None:
            by_front: dict[int, Cells] = {pos: front for pos, front, _ in part}
            out += [(pos, by_front[pos] + cells) for pos, cells in _settled([(pos, rest) for pos, _, rest in part])]
            continue
        have, others = [], []
        for pos, front, rest in part:
            first = [c for c in rest if c[1] == value]
            if not first:
                others.append((pos, front, rest))
                continue
            tied = {d for n, _ in first for d in (depends or {}).get(n, ())}
            first += [c for c in rest if c[0] in tied and c not in first]
            have.append((pos, front + first, [c for c in rest if c not in first]))
        work += [([], others)] if others else []
        # rows that moved equal cells to the front stay together and go on
        groups: dict[tuple, list] = {}
        for row in have:
            groups.setdefault(tuple(v for _, v in row[1]), []).append(row)
        work += [([], groups[k]) for k in sorted(groups, reverse=True)]
    return out


def best_small(rows: list[tuple[int, Cells]]) -> tuple[int, list[tuple[int, Cells]]]:
    """The best score, squared lengths of cells shared with the row before, that choosing a
    (column, value) group at a time can reach, by trying all. For tiny tables, to
    measure ``greedy`` against."""
    if not rows or not rows[0][1]:
        return 0, list(rows)
    best, found = 0, [(pos, cells) for pos, cells in rows]
    seen = {c for _, cells in rows for c in cells}
    for name, value in sorted(seen):
        have = [(pos, [c for c in cells if c != (name, value)]) for pos, cells in rows if (name, value) in cells]
        if len(have) < 2:
            continue
        others = [(pos, cells) for pos, cells in rows if (name, value) not in cells]
        a, left = best_small(have)
        b, right = best_small(others)
        if (score := a + b + _weight(value) * (len(have) - 1)) > best:
            best, found = score, [(pos, [(name, value), *cells]) for pos, cells in left] + right
    return best, found


def shared_weight(rows: list[tuple[int, Cells]]) -> int:
    """Squared lengths of the leading cells that each row shares with the one before."""
    total = 0
    for (_, a), (_, b) in zip(rows, rows[1:], strict=False):
        for (_, x), (_, y) in zip(a, b, strict=False):
            if x != y:
                break
            total += _weight(x)
    return total


def greedy_layout(df: DataFrame, key: str, *names: str, early_stop: float = 0, discard: float = 0.8, chunk_rows: int = CHUNK_ROWS, depends: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """chunk, pos, key, cells: rows in their new order with their cells, nearly unique columns
    (more than ``discard`` of the rows distinct) last.

    Rows are first sorted by range along the fixed order and cut into chunks of about
    ``chunk_rows``, so that similar rows share a chunk; chunks are independent.
    """
    ship(df.sparkSession)
    chosen = [c for c in (names or df.columns) if c != key]
    blank = {c: {"score": 0.0, "place": i, "n_distinct": 0, "n_rows": 0} for i, c in enumerate(chosen)}
    stats = blank | {r["column"]: r for r in column_stats(df, *chosen).collect()}  # one row per column
    order = sorted(chosen, key=lambda c: (-stats[c]["score"], stats[c]["place"]))
    kept = [c for c in order if stats[c]["n_distinct"] <= stats[c]["n_rows"] * discard]
    last = [c for c in order if c not in kept]
    n = max((r["n_rows"] for r in stats.values()), default=0)
    chunks = max(1, -(-n // chunk_rows))
    texts = df.select(F.col(key), *[_text(df, c).alias(c) for c in order])
    sort = [F.col(f"`{c}`") for c in kept] + [F.col(key)]
    dealt = texts.repartitionByRange(chunks, *sort).withColumn("chunk", F.spark_partition_id())

    def arrange(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*kept, key], kind="stable").reset_index(drop=True)
        records = pdf.to_dict("records")
        rows = greedy([(i, [(c, r[c]) for c in kept]) for i, r in enumerate(records)], early_stop, depends)
        cells = [[{"name": a, "value": b} for a, b in [*cs, *[(c, records[i][c]) for c in last]]] for i, cs in rows]
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[0], "pos": range(len(rows)), key: [records[i][key] for i, _ in rows], "cells": cells})

    kind = df.schema[key].dataType.simpleString()
    return dealt.groupBy("chunk").applyInPandas(arrange, f"chunk int, pos int, `{key}` {kind}, cells array<struct<name:string,value:string>>")
