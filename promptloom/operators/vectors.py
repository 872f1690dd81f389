"""Vector expressions, nearest vectors, and choosing k of N vectors per group.

Similarities are built-in expressions over array columns. Selections are greedy and need
all vectors of a group at once (the tokens of one image, say), so they are numpy
kernels under ``applyInPandas``, in memory that grows with the vectors; groups are spread over the cluster. Kernels work
in float64 on vectors in the order of their ids and break ties by the smaller index.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from promptloom.shipping import ship

EPS = 1e-6
#: Bytes of stated query vectors that are sent to every executor at once.
BLOCK_BYTES = 64 << 20
#: Vectors whose similarities to all others are held at once.
PAIR_ROWS = 64
#: Candidates that a choice among roundings takes up at once.
SLOTS = 512
#: Of these, and of earlier choices, how many are added up at once.
SUM_SLOTS, SUM_STEPS = 64, 2048
#: Numbers that do not fit four bytes and are kept one by one.
MANY_WIDE = 10_000
#: The least that the SQL divides by in a determinantal point process, squared.
LEAST_REST = 1e-12


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where one vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def in_blocks(queries: DataFrame, key: str, vec: str, limit: int = BLOCK_BYTES) -> list[DataFrame]:
    """The query set in parts that each hold about ``limit`` bytes of vectors, by measure."""
    size = queries.agg(F.sum(8 * F.size(vec) + 64)).first()[0] or 0
    parts = -(-size // limit) or 1
    if parts == 1:
        return [queries]
    return [queries.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == i) for i in range(parts)]


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Array cells as rows of doubles; null cells, ones of another length and ones with a
    null are rows of NaN."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten()
    if column.null_count == 0 and flat.null_count == 0 and pc.all(pc.equal(pc.list_value_length(column), dims), min_count=0).as_py():
        return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    whole = lambda v: v is not None and len(v) == dims and None not in v
    return np.array([v if whole(v) else [np.nan] * dims for v in column.to_pylist()], np.float64).reshape(-1, dims)


def dims_of(column: pa.ChunkedArray) -> int:
    return pc.max(pc.list_value_length(column)).as_py() or 0


def nearest(queries: DataFrame, rows: DataFrame, query_id: str, row_id: str, query_vec: str, row_vec: str, k: int, digits: int = 6, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k most similar rows of each stated query vector; ties go to the smaller id. The
    query set is sent to the tasks in blocks of ``block_bytes``; a task meets all its rows
    with them by products of matrices and keeps its own best, before the shuffle."""
    ship(rows.sparkSession)
    kinds = {c: df.schema[c].dataType for df, c in ((queries, query_id), (rows, row_id))}
    schema = StructType().add(query_id, kinds[query_id]).add(row_id, kinds[row_id]).add("similarity", DoubleType())
    found = []
    for block in in_blocks(queries, query_id, query_vec, block_bytes):
        asked = rows.sparkSession.sparkContext.broadcast(block.select(query_id, query_vec).toArrow())
        found.append(rows.select(row_id, row_vec).mapInArrow(_best_rows(asked, query_id, query_vec, row_id, row_vec, k, digits), schema))
    order = Window.partitionBy(query_id).orderBy(F.desc("similarity"), row_id)
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _best_rows(asked: Broadcast, query_id: str, query_vec: str, row_id: str, row_vec: str, k: int, digits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = asked.value
        ids, dims, scale = table.column(query_id).combine_chunks(), dims_of(table.column(query_vec)), 10**digits
        q = unit(matrix(table.column(query_vec), dims))
        kept_ids, kept = None, np.zeros((len(q), 0))
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch.column(row_id)))  # so that of equal ones the first come first
            r = unit(matrix(batch.column(row_vec), dims)).T
            best, n = np.empty((len(q), min(k, len(batch))), np.int64), len(batch)
            score = np.empty(best.shape)
            for at in range(0, len(q), PAIR_ROWS):
                s = q[at : at + PAIR_ROWS] @ r * scale
                s = np.copysign(np.floor(np.abs(s) + 0.5), s)
                # whole numbers, then the place in the batch; without a similarity last
                key = np.where(np.isnan(s), -2 * scale, s).astype(np.int64) * n + (n - 1 - np.arange(n))
                top = np.argpartition(-key, best.shape[1] - 1, axis=1)[:, : best.shape[1]] if n > k else np.tile(np.arange(n), (len(s), 1))
                best[at : at + PAIR_ROWS] = top
                score[at : at + PAIR_ROWS] = np.take_along_axis(s, top, 1)
            names = np.array(batch.column(row_id).to_pylist(), object)[best]
            kept_ids = names if kept_ids is None else np.hstack([kept_ids, names])
            kept = np.hstack([kept, score])
            if kept.shape[1] > 8 * k:
                kept_ids, kept = _cut(kept_ids, kept, k)
        if kept_ids is not None and len(q):
            kept_ids, kept = _cut(kept_ids, kept, k)
            width = kept.shape[1]
            value = pa.array((kept / scale).ravel(), pa.float64(), from_pandas=True)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(len(q)), width))), pa.array(kept_ids.ravel().tolist(), batch.schema.field(row_id).type), value], [query_id, row_id, "similarity"])

    return run


def _cut(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of every row; ties go to the smaller id."""
    place = np.unique(ids.ravel(), return_inverse=True)[1].reshape(ids.shape)
    order = np.lexsort((place, -scores), axis=-1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def close_pairs(left: DataFrame, right: DataFrame, left_vec: str, right_vec: str, least: float, keep: bool = True) -> DataFrame:
    """The pairs whose cosine is at least ``least``, or one of whose vectors is null or empty,
    by products of matrices; those within rounding of ``least`` are summed in order. ``right``
    is sent to the tasks as a whole. Without ``keep`` the pairs come without the vectors."""
    ship(left.sparkSession)
    sent = left.sparkSession.sparkContext.broadcast(right.toArrow())
    names = [(n, c) for n, df in enumerate((left, right)) for c in df.columns if keep or c not in (left_vec, right_vec)]
    schema = StructType([(left, right)[n].schema[c] for n, c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others = sent.value.combine_chunks()
        far_side = others.column(right_vec)
        for batch in batches:
            near_side = batch.column(left_vec)
            dims = max(dims_of(near_side), dims_of(far_side))
            x, y = matrix(near_side, dims), matrix(far_side, dims)
            u, v = unit(x), unit(y).T
            blank = [pc.fill_null(pc.equal(pc.list_value_length(c), 0), True).to_numpy(zero_copy_only=False) for c in (near_side, far_side)]
            for at in range(0, len(x), PAIR_ROWS):
                s = u[at : at + PAIR_ROWS] @ v
                i, j = np.nonzero(np.abs(s - least) < 1e-9)
                s[i, j] = cosines(x[at + i], y[j])
                i, j = np.nonzero((s >= least) | blank[0][at : at + PAIR_ROWS, None] | blank[1][None, :])
                places = (pa.array(at + i), pa.array(j))
                cells = [(batch, others)[n].column(c).take(places[n]) for n, c in names]
                yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cells], names=[c for _, c in names])

    return left.mapInArrow(run, schema)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``cosine`` of rows with rows, in its order."""
    size = np.sqrt(in_order((x * x).T)) * np.sqrt(in_order((y * y).T))
    return np.divide(in_order((x * y).T), size, out=np.zeros(len(x)), where=size > 0)


def means(df: DataFrame, vec: str, *by: str, scale: Column | None = None) -> DataFrame:
    """The mean vector (``mean``), of vectors times ``scale``, for each ``by``."""
    spot = df.select(*by, vec, (F.lit(1.0) if scale is None else scale).alias("__scale")).select(*by, "__scale", F.posexplode(vec).alias("__pos", "__x"))
    each = spot.groupBy(*by, "__pos").agg(F.avg(F.col("__x").cast("double") * F.col("__scale")).alias("__m"))
    listed = each.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__pos", "__m"))).alias("__all"))
    return listed.select(*by, F.transform("__all", lambda s: s["__m"]).alias("mean")).filter(F.size("mean") > 0)


def relevance(rows: DataFrame, texts: DataFrame, row_id: str, row_vec: str, text_vec: str) -> DataFrame:
    """Mean of the negative cosine to all text vectors per row, scaled to 0..1 over the table.
    The mean of the cosines is the product of the row's unit vector and the mean of the
    texts' unit vectors, so rows and texts are read once each and never paired."""
    size = norm(F.col(text_vec))
    mean = means(texts, text_vec, scale=F.when(size > 0, 1 / size).otherwise(F.lit(0.0)))
    length = norm(F.col(row_vec))
    one = F.when(length > 0, -dot(F.col(row_vec), F.col("mean")) / length).otherwise(F.when(length.isNotNull(), F.lit(0.0)))
    raw = rows.crossJoin(F.broadcast(mean)).groupBy(row_id).agg(F.avg(one).alias("raw"))
    ends = raw.agg(F.min("raw").alias("low"), F.max("raw").alias("high"))
    return raw.crossJoin(F.broadcast(ends)).select(row_id, ((F.col("raw") - F.col("low")) / (F.col("high") - F.col("low") + EPS)).alias("relevance"))


def mean_squared_distance(rows: DataFrame, texts: DataFrame, group: str, row_id: str, vec: str) -> DataFrame:
    """(group, id, distance): the mean squared distance of each row to the text vectors of
    its group, as that to their mean and theirs to it; no row is paired with a text."""
    mean = means(texts, vec, group)
    inside = texts.join(F.broadcast(mean), group).groupBy(group).agg(F.avg(squared_distance(F.col(vec), F.col("mean"))).alias("__inside"))
    known = F.broadcast(mean.join(inside, group))
    return rows.join(known, group).groupBy(group, row_id).agg(F.avg(squared_distance(F.col(vec), F.col("mean")) + F.col("__inside")).alias("distance"))


# ---- kernels: (vectors N x d, texts M x d, k) -> chosen indices, sorted
#
# No kernel holds N x N numbers: similarities are made a row at a time. Sums are taken in the
# order in which the SQL takes them, so equal vectors have equal scores to the last bit.


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    size = np.sqrt(own_dots(columns_of(x)))[:, None]
    return np.divide(x, size, out=np.zeros_like(x), where=size != 0)


def in_order(rows: Iterable[np.ndarray]) -> np.ndarray | float:
    """The sum of ``rows``, from the first to the last."""
    total = 0.0
    for row in rows:
        total = total + row
    return total


def columns_of(x: np.ndarray) -> np.ndarray:
    """Vectors as columns, d x N."""
    return np.ascontiguousarray(np.asarray(x, np.float64).T)


def row_dots(columns: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Dot products of ``v`` with every column. A product of matrices with a few rows adds up
    the terms of each number one after the other, fused, as the SQL does; a single row
    would be taken in another order and is sent twice."""
    return (np.stack([v, v]) @ columns)[0]


def own_dots(columns: np.ndarray) -> np.ndarray:
    """The dot product of every column with itself."""
    return fused_dots(columns, columns)


def fused_dots(columns: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The sum of ``columns[t] * others[t]``, from the first t to the last, each product added
    with a single rounding, as the SQL does. Products of matrices do so too, but not on
    every processor; these are the same on all. ``others`` may be numbers or be broadcast."""
    shape = np.broadcast_shapes(columns.shape[1:], others.shape[1:])
    if shape[-1] == 1:  # numpy rounds the product of a single number
        return fused_dots(np.repeat(columns, 2, axis=-1), np.repeat(others, 2, axis=-1) if others.shape[1:] else others)[..., : shape[-1]]
    return (_by_complex if _complex_is_fused() else _by_parts)(columns, others, shape)


def _by_complex(columns: np.ndarray, others: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """(x + is)(1 + iy) has the imaginary part xy + s, which numpy makes with one rounding
    where the processor can."""
    total, by = np.zeros(shape, complex), np.ones(others.shape[1:], complex)
    for x, y in zip(columns, others, strict=True):
        total.real = x
        if others.ndim == 1:
            total *= complex(1, y)
        else:
            by.imag = y
            total *= by
    return total.imag.copy()


def _by_parts(columns: np.ndarray, others: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """With the rounding errors of product and sum, added last."""
    total = np.zeros(shape)
    for x, y in zip(columns, others, strict=True):
        high, top = (v * 134217729.0 - (v * 134217729.0 - v) for v in (x, y))
        low, end = x - high, y - top
        p = x * y
        s = total + p
        z = s - total
        total = s + (((total - (s - z)) + (p - z)) + (((high * top - p) + high * end + low * top) + low * end))
    return total


@cache
def _complex_is_fused() -> bool:
    some = np.random.default_rng(0)
    for n in (2, 3, 4, 5, 8, 9, 33, 1000):
        a = some.normal(size=(9, n))
        for x, y in ((a, some.normal(size=9)), (a, some.normal(size=(9, n))), (a[:, None, :], some.normal(size=(9, 7, 1)))):
            shape = np.broadcast_shapes(x.shape[1:], y.shape[1:])
            if not np.array_equal(_by_complex(x, y, shape), _by_parts(x, y, shape)):
                return False
    return True


def similarity(x: np.ndarray) -> np.ndarray:
    """All pairs at once: for a few vectors."""
    u = unit(x)
    return u @ u.T


def mean_cosine(x: np.ndarray, texts: np.ndarray, dots: Callable = row_dots) -> np.ndarray:
    columns, total = columns_of(unit(x)), np.zeros(len(x))
    for text in unit(texts):
        total += dots(columns, text)
    return total / max(len(texts), 1)


def scaled(raw: np.ndarray) -> np.ndarray:
    return (raw - raw.min() + EPS) / (raw.max() - raw.min() + EPS)


def keep_count(n: int, ratio: float) -> int:
    return n if ratio >= 1 else max(0, min(n, int(ratio * n)))


def greedy_dpp(x: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """Greedy maximum-a-posteriori set of a determinantal point process with the kernel
    w_i S_ij w_j, by updating the Cholesky factor a row at a time, until nothing but
    rounding is left; then by ``_choose_among_roundings``."""
    columns = columns_of(unit(x))
    left = weight * own_dots(columns) * weight
    factor: list[np.ndarray] = []
    chosen: list[int] = []
    while len(chosen) < k and not left.max() <= LEAST_REST:
        j = int(np.argmax(left))
        chosen.append(j)
        known = in_order(row * row[j] for row in factor)
        factor.append((weight[j] * fused_dots(columns, columns[:, j]) * weight - known) / np.sqrt(max(left[j], LEAST_REST)))
        left -= factor[-1] ** 2
        left[chosen] = -np.inf
    if len(chosen) < k:
        rows = np.reshape(factor, (len(factor), len(weight)))
        factor.clear()
        _choose_among_roundings(columns, weight, left, rows, chosen, k)
    return np.sort(chosen)


def _true_places(marks: np.ndarray) -> np.ndarray:
    """``np.flatnonzero``, faster where few are true: eight are looked at together."""
    eights = marks[: len(marks) // 8 * 8].view(np.int64)
    some = np.flatnonzero(eights.astype(bool))
    found = np.flatnonzero(eights[some].view(bool))
    return np.concatenate([some[found >> 3] * 8 + (found & 7), 8 * len(eights) + np.flatnonzero(marks[8 * len(eights) :])])


def _choose_among_roundings(columns: np.ndarray, weight: np.ndarray, left: np.ndarray, factor: np.ndarray, chosen: list[int], k: int) -> None:
    """Adds to ``chosen`` up to k, as further rows of the factor would, without making them.
    What is left only falls. So a candidate that was never met since ``factor`` ended has at
    most what it had then, and is taken up, in a slot, when this could be the most. Of the
    further rows a slot keeps its own numbers, before their division: differences of
    almost equal numbers, which fit four bytes (others stand in ``wide``; when those are
    many, all get eight bytes)."""
    first, steps, size = len(chosen), k - len(chosen), np.sqrt(LEAST_REST)
    order = np.argsort(-left, kind="stable")[: len(left) - first]
    taken = 0
    who = np.zeros(0, int)
    rest, own, most = np.zeros(0), np.zeros(0), np.zeros(0)
    head, vectors = np.zeros((first, 0)), np.zeros((len(columns), 0))
    noise = np.zeros((0, steps), np.float32)
    past: list[tuple[np.ndarray, float]] = []  # noise of those chosen here, and the largest of their numbers
    wide: dict[int, dict[int, float]] = {}
    space = [np.empty(SUM_SLOTS * SUM_STEPS, kind) for kind in (np.float32, bool)]

    def numbers(i: int, stored: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The numbers of candidate i at the steps ``at``."""
        found = stored.astype(np.float64)
        if i in wide:
            found = np.array([wide[i].get(s, value) for s, value in zip(at.tolist(), found.tolist(), strict=True)])
        return found / size

    def add_products(s: int, slots: np.ndarray, known: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """``known`` of a few slots with the products of their numbers and those of the s-th choice,
        one after the other. A product under 2 ** -54 of the sum leaves it as it is and is
        left out, unless all together could change the sum by a thousandth."""
        its = numbers(chosen[first + s], past[s][0], np.arange(s))
        least = 0.998 * 2.0**-54 * np.abs(known) * size
        least = np.where((s * reach < np.abs(known) / 1000) & (least > 1e-36), least, 0).astype(np.float32)[:, None]
        rough_its, lines = its.astype(np.float32), np.arange(len(slots))
        odd = [(line, i) for line, i in enumerate(who[slots].tolist()) if i in wide]
        for t in range(0, s, SUM_STEPS):
            wide_at = min(SUM_STEPS, s - t)
            stored = noise[slots, t : t + wide_at]
            rough, large = (v[: len(slots) * wide_at].reshape(len(slots), wide_at) for v in space)
            np.multiply(stored, rough_its[t : t + wide_at], out=rough)
            np.greater_equal(np.abs(rough, out=rough), least, out=large)
            at = _true_places(large.ravel())
            line = at // wide_at
            step = at - line * wide_at
            each = stored.ravel()[at].astype(np.float64) / size
            step += t
            for r, i in odd:
                part = slice(*np.searchsorted(line, [r, r + 1]))
                each[part] = numbers(i, noise[slots[r]][step[part]], step[part])
            each *= its[step]
            known = np.bincount(np.concatenate([lines, line]), np.concatenate([known, each]), len(slots))  # adds in this order
        return known

    def meet(s: int, slots: np.ndarray, kernel: np.ndarray, known: np.ndarray) -> None:
        """Takes the s-th choice made here out of what is left of the candidates in ``slots``."""
        reach = past[s][1] * most[slots]
        near = np.flatnonzero((reach >= np.abs(known) * 2.0**-54) & (reach > 0))
        for at in range(0, len(near), SUM_SLOTS):
            some = near[at : at + SUM_SLOTS]
            known[some] = add_products(s, slots[some], known[some], reach[some])
        raw = kernel - known
        short = raw.astype(noise.dtype)
        noise[slots, s] = short
        for at in np.flatnonzero(short != raw):
            wide.setdefault(int(who[slots[at]]), {})[s] = float(raw[at])
        raw /= size
        rest[slots] -= raw * raw
        most[slots] = np.maximum(most[slots], np.abs(raw))

    while len(past) < steps:
        if sum(map(len, wide.values())) > MANY_WIDE:
            noise, past = noise.astype(np.float64), [(v.astype(np.float64), top) for v, top in past]
            rows_of = {int(i): noise[slot] for slot, i in enumerate(who) if rest[slot] > -np.inf} | dict(zip(chosen[first:], (v for v, _ in past), strict=True))
            for i, values in wide.items():
                rows_of[i][list(values)] = list(values.values())
            wide.clear()
        best = rest.max(initial=-np.inf)
        if taken < len(order) and best <= left[order[taken]]:
            new = order[taken : taken + max(SLOTS, len(order) // 64)]
            taken += len(new)
            slots = np.flatnonzero(rest == -np.inf)
            if len(slots) < len(new):
                more = len(new) - len(slots)
                slots = np.append(slots, np.arange(len(rest), len(rest) + more))
                who, rest, own, most = (np.append(v, np.zeros(more, v.dtype)) for v in (who, rest, own, most))
                head, vectors = (np.hstack([v, np.zeros((len(v), more))]) for v in (head, vectors))
                noise.resize((len(rest), steps), refcheck=False)
            slots = slots[: len(new)]
            who[slots], rest[slots], own[slots], most[slots] = new, left[new], weight[new], 0
            head[:, slots], vectors[:, slots] = factor[:, new], columns[:, new]
            for at in range(0, len(past), PAIR_ROWS):
                js = chosen[first + at : first + at + PAIR_ROWS]
                kernel = weight[js][:, None] * fused_dots(columns[:, None, new], columns[:, js, None]) * weight[new]
                known = np.zeros(kernel.shape)
                for row in factor:
                    known += row[js][:, None] * row[new]
                for s in range(len(js)):
                    meet(at + s, slots, kernel[s], known[s])
            continue
        slot = np.flatnonzero(rest == best)
        slot = slot[np.argmin(who[slot])]
        j, s = int(who[slot]), len(past)
        chosen.append(j)
        past.append((noise[slot, :s].copy(), most[slot]))
        rest[slot], own[slot], most[slot], head[:, slot] = -np.inf, 0, 0, 0
        known, buffer = np.zeros(len(rest)), np.empty(len(rest))
        for row, value in zip(head, factor[:, j], strict=True):
            known += np.multiply(row, value, out=buffer)
        meet(s, np.arange(len(rest)), weight[j] * fused_dots(vectors, columns[:, j]) * own, known)


def jittered_dpp(x: np.ndarray, weight: np.ndarray, k: int, jitter: float) -> np.ndarray:
    """``greedy_dpp`` of the kernel with ``jitter`` added to its diagonal. The kernel is
    B'B + jitter I with B of d rows; given the chosen, what is left of it is B'MB + jitter I
    with M of d x d, so no factor of k x N is needed."""
    columns = columns_of(unit(x)) * weight
    left = in_order(columns * columns) + jitter
    inner = np.eye(len(columns))
    chosen: list[int] = []
    for _ in range(k):
        j = int(np.argmax(left))
        chosen.append(j)
        v = inner @ columns[:, j]
        inner -= np.outer(v, v / left[j])
        left -= row_dots(columns, v) ** 2 / left[j]
        left[chosen] = -np.inf
    return np.sort(chosen)


def conditional_dpp(x: np.ndarray, texts: np.ndarray, k: int, theta: float | None = None) -> np.ndarray:
    """Diversity conditioned on relevance to the texts: kernel r_i S_ij r_j. With ``theta``
    under 1 the relevance is exp(theta / (2 (1 - theta)) r); at 1 it is left as it is."""
    r = scaled(-mean_cosine(x, texts, fused_dots))
    if theta is not None and theta < 1:
        r = np.exp(theta / (2 * (1 - theta)) * r)
    return greedy_dpp(x, r, k)


def text_stage(x: np.ndarray, texts: np.ndarray, share: float = 0.8) -> np.ndarray:
    """The share of vectors with the least mean squared distance to the texts; without
    texts all score alike."""
    columns, far = columns_of(x), np.zeros(len(x))
    for text in np.asarray(texts, np.float64):
        total = np.zeros(len(x))
        for row, number in zip(columns, text, strict=True):
            apart = row - number
            apart *= apart
            total += apart
        far += total
    return np.sort(np.argsort(far / max(len(texts), 1), kind="stable")[: int(share * len(x))])


def spread(x: np.ndarray, k: int) -> np.ndarray:
    """First the vector least similar to all on average, then always that least similar on
    average to those chosen."""
    if k <= 0:
        return np.zeros(0, int)
    columns = columns_of(unit(x))
    # the mean of similarities is the similarity to the mean
    chosen = [int(np.argmin(row_dots(columns, columns.mean(1))))]
    total = row_dots(columns, columns[:, chosen[0]])
    while len(chosen) < min(k, len(x)):
        mean = total / len(chosen)
        mean[chosen] = np.inf
        chosen.append(int(np.argmin(mean)))
        total += row_dots(columns, columns[:, chosen[-1]])
    return np.sort(chosen)


def two_stage(x: np.ndarray, texts: np.ndarray, k: int) -> np.ndarray:
    """Text stage, then ``spread`` among what it leaves."""
    first = text_stage(x, texts)
    return np.sort(first[spread(np.asarray(x)[first], min(k, len(first)))])


def text_diversity(x: np.ndarray, texts: np.ndarray, k: int, diversity: float = 0.6) -> np.ndarray:
    """First the most relevant; then diversity * (minus mean similarity to the chosen) + the
    rest of the weight on relevance."""
    columns, r = columns_of(unit(x)), mean_cosine(x, texts)
    chosen: list[int] = []
    total = np.zeros(len(x))
    while len(chosen) < min(k, len(x)):
        score = diversity * -(total / max(len(chosen), 1)) + (1 - diversity) * r if chosen else r.copy()
        score[chosen] = -np.inf
        chosen.append(int(np.argmax(score)))
        total += row_dots(columns, columns[:, chosen[-1]])
    return np.sort(chosen)


def weighted_dpp(x: np.ndarray, texts: np.ndarray, k: int, jitter: float = 1e-6) -> np.ndarray:
    """DPP with quality max(relevance, 0) + 0.1."""
    q = np.sqrt(np.maximum(mean_cosine(x, texts), 0) + 0.1)
    return jittered_dpp(x, q, min(k, len(x)), jitter)


def text_farthest(x: np.ndarray, texts: np.ndarray, k: int) -> np.ndarray:
    """Farthest points with weights sigmoid(2 * relevance): first the heaviest, then the
    largest weight times distance to the nearest chosen one."""
    w = 1 / (1 + np.exp(-2 * mean_cosine(x, texts)))
    return _farthest(columns_of(unit(x)), int(np.argmax(w)), k, w) if len(x) and k > 0 else np.zeros(0, int)


def _farthest(columns: np.ndarray, first: int, k: int, weight: np.ndarray) -> np.ndarray:
    chosen, most = [first], row_dots(columns, columns[:, first])
    while len(chosen) < min(k, len(weight)):
        score = (1 - most) * weight
        score[chosen] = -np.inf
        chosen.append(int(np.argmax(score)))
        most = np.maximum(most, row_dots(columns, columns[:, chosen[-1]]))
    return np.sort(chosen)


def loneliest(columns: np.ndarray) -> int:
    """The column whose most similar other is least similar. All pairs are met in blocks of
    ``PAIR_ROWS``; those within rounding of the least are compared again, in order, of equal
    ones only the first."""
    n, most = columns.shape[1], np.empty(columns.shape[1])
    for at in range(0, n, PAIR_ROWS):
        s = columns[:, at : at + PAIR_ROWS].T @ columns
        s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
        most[at : at + PAIR_ROWS] = s.max(1)
    close = np.flatnonzero(most <= most.min() + 1e-12)
    close = close[np.sort(np.unique(columns[:, close].T, axis=0, return_index=True)[1])]
    return int(close[np.argmin([np.delete(row_dots(columns, columns[:, i]), i).max() for i in close])])


def max_min(x: np.ndarray, k: int) -> np.ndarray:
    """Max-min diversity by cosine distance; first the vector whose nearest other is farthest."""
    if len(x) < 2 or k <= 0:
        return np.arange(min(len(x), max(k, 0)))
    columns = columns_of(unit(x))
    return _farthest(columns, loneliest(columns), k, np.ones(len(x)))


def score_minus_similarity(x: np.ndarray, score: np.ndarray, k: int, penalty: float = 0.8) -> np.ndarray:
    """Always the best score; then every score loses ``penalty`` times its similarity to it."""
    columns, score, chosen = columns_of(unit(x)), np.asarray(score, np.float64), []
    total = np.zeros(len(x))
    while len(chosen) < min(k, len(x)):
        left = score - penalty * total
        left[chosen] = -np.inf
        chosen.append(int(np.argmax(left)))
        total += row_dots(columns, columns[:, chosen[-1]])
    return np.sort(chosen)


def least_max_similarity(x: np.ndarray, k: int, first: int = 0) -> np.ndarray:
    """From a seed on, always the vector whose largest similarity to the chosen is least."""
    if k <= 0 or not len(x):
        return np.zeros(0, int)
    return _farthest(columns_of(unit(x)), first, k, np.ones(len(x)))


def attention_and_diversity(x: np.ndarray, texts: np.ndarray, k: int, attention: np.ndarray, important: float = 0.6, recovery: float = 0.0) -> np.ndarray:
    """int(important * k) vectors by attention, the rest for diversity among the others, and
    int(recovery * N) more of those left out by softmaxed similarity to the texts. All
    others take part in the diversity step; nothing is sampled."""
    order = np.argsort(-np.asarray(attention, np.float64), kind="stable")
    top = order[: int(important * k)]
    rest = np.sort(order[len(top) :])
    more = score_minus_similarity(np.asarray(x)[rest], np.ones(len(rest)), k - len(top)) if len(rest) else rest
    chosen = np.concatenate([top, rest[more]])
    extra = int(recovery * len(x))
    if extra and len(texts):
        left = np.setdiff1d(np.arange(len(x)), chosen)
        chosen = np.concatenate([chosen, left[np.argsort(-mean_cosine(x, texts)[left], kind="stable")[:extra]]])
    return np.sort(chosen)


def outlier_ratio(values: np.ndarray) -> float:
    """Share of values over Q3 + 1.5 IQR."""
    low, high = np.percentile(values, [25, 75])
    return float((np.asarray(values) > high + 1.5 * (high - low)).mean())


def merge_tokens(x: np.ndarray, attention: np.ndarray, neighbours: int = 32, spaced: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Keep int(N * outlier ratio of the attention) vectors (one at least), with ``spaced``
    also every int(int(1 / ratio) / 3)-th; each kept one gains the attention-weighted sum
    of its nearest ``neighbours`` others. Returns (indices, vectors), the vectors with
    one more at the end: the attention-weighted sum of all that were left out."""
    x, a = np.asarray(x, np.float64), np.asarray(attention, np.float64)
    ratio = max(outlier_ratio(a), 1 / len(x))
    kept = np.argsort(-a, kind="stable")[: max(1, int(len(x) * ratio))]
    if spaced:
        kept = np.union1d(kept, np.arange(0, len(x), max(1, int(int(1 / ratio) / 3))))
    kept = np.sort(kept)
    columns, merged = columns_of(unit(x)), x[kept]
    for at, i in enumerate(kept):
        s = row_dots(columns, columns[:, i])
        s[i] = -np.inf
        near = np.argsort(-s, kind="stable")[: min(neighbours, len(x) - 1)]
        merged[at] += (a[near][:, None] * x[near]).sum(0)
    left = np.setdiff1d(np.arange(len(x)), kept)
    return kept, np.vstack([merged, (a[left, None] * x[left]).sum(0)])


def pad(matrices: list[np.ndarray]) -> np.ndarray:
    """Matrices of different length as one array, zero rows at the end of short ones."""
    most, width = max(map(len, matrices)), matrices[0].shape[1]
    out = np.zeros((len(matrices), most, width))
    for i, m in enumerate(matrices):
        out[i, : len(m)] = m
    return out


def collapse_runs(tokens: Column, mark: int) -> Column:
    """An array of token ids with every run of ``mark`` reduced to one."""
    kept = F.filter(F.transform(tokens, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: (s["x"] != mark) | (s["i"] == 0) | (F.get(tokens, F.when(s["i"] > 0, s["i"] - 1).otherwise(F.lit(0)).cast("int")) != mark))
    return F.transform(kept, lambda s: s["x"])


Kernel = Callable[[np.ndarray, np.ndarray, int], np.ndarray]
#: Kernels by name: what ``select_vectors`` takes.
KERNELS: dict[str, Kernel] = {
    "cd": conditional_dpp,
    "trim": two_stage,
    "spread": lambda x, _, k: spread(x, k),
    "text_div": text_diversity,
    "dpp": weighted_dpp,
    "fps": text_farthest,
    "div": lambda x, _, k: max_min(x, k),
    "score_minus": lambda x, _, k: score_minus_similarity(x, np.ones(len(x)), k),
    "score_minus_text": lambda x, t, k: score_minus_similarity(x, mean_cosine(x, t), k),
    "min_max": lambda x, _, k: least_max_similarity(x, k),
    "vis": lambda x, t, k: attention_and_diversity(x, t, k, -mean_cosine(x, t)),
}


def select_vectors(df: DataFrame, group: str, row_id: str, vec: str, kernel: str | Kernel, keep_ratio: float, is_text: str | None = None) -> DataFrame:
    """(group, id, rank) of the vectors kept in each group; ``is_text`` is a boolean column
    that marks the text vectors, which guide the choice and are not candidates."""
    ship(df.sparkSession)
    chosen = KERNELS[kernel] if isinstance(kernel, str) else kernel
    kinds = {c: df.schema[c].dataType.simpleString() for c in (group, row_id)}

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(row_id, kind="stable")
        text = pdf[is_text].to_numpy(bool) if is_text else np.zeros(len(pdf), bool)
        x = np.stack(pdf[vec]).astype(np.float64)
        rows = pdf[~text]
        k = keep_count(len(rows), keep_ratio)
        at = np.arange(len(rows)) if k == len(rows) else chosen(x[~text], x[text], k) if k else np.zeros(0, int)
        return pd.DataFrame({group: rows[group].to_numpy()[at], row_id: rows[row_id].to_numpy()[at], "rank": np.arange(len(at), dtype=np.int32)})

    columns = [group, row_id, vec, *([is_text] if is_text else [])]
    # by range, as a group can take minutes and hashing puts several into one task
    dealt = df.select(*columns).repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), group)
    return dealt.groupBy(group).applyInPandas(choose, f"`{group}` {kinds[group]}, `{row_id}` {kinds[row_id]}, rank int")
