import tracemalloc
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from promptloom.operators import vectors as V
from promptloom.plans import queries as q

rng = np.random.default_rng(5)
X, T = rng.normal(size=(24, 6)), rng.normal(size=(3, 6))


def greedy_by_determinant(kernel, k):
    chosen = []
    for _ in range(k):
        gains = [np.linalg.det(kernel[np.ix_(chosen + [j], chosen + [j])]) if j not in chosen else -np.inf for j in range(len(kernel))]
        chosen.append(int(np.argmax(gains)))
    return sorted(chosen)


def test_dpp_is_greedy_determinant_maximisation():
    r = V.scaled(-V.mean_cosine(X, T))
    assert list(V.conditional_dpp(X, T, 5)) == greedy_by_determinant(r[:, None] * V.similarity(X) * r[None], 5)
    q = np.sqrt(np.maximum(V.mean_cosine(X, T), 0) + 0.1)
    assert list(V.weighted_dpp(X, T, 5)) == greedy_by_determinant(V.similarity(X) * q[:, None] * q[None] + 1e-6 * np.eye(24), 5)


def test_spread_and_farthest_by_recomputation():
    s, chosen = V.similarity(X), []
    chosen.append(int(np.argmin(s.mean(1))))
    while len(chosen) < 6:
        left = [j for j in range(24) if j not in chosen]
        chosen.append(min(left, key=lambda j: (s[j, chosen].mean(), j)))
    assert list(V.spread(X, 6)) == sorted(chosen)
    d = 1 - s
    w = 1 / (1 + np.exp(-2 * V.mean_cosine(X, T)))
    far = [int(np.argmax(w))]
    while len(far) < 6:
        left = [j for j in range(24) if j not in far]
        far.append(max(left, key=lambda j: (d[j, far].min() * w[j], -j)))
    assert list(V.text_farthest(X, T, 6)) == sorted(far)


@pytest.mark.parametrize("name", sorted(V.KERNELS))
@pytest.mark.parametrize("k", [1, 5, 24])
def test_kernels_choose_k_distinct_sorted(name, k):
    got = V.KERNELS[name](X, T, k)
    assert len(got) == len(set(got)) == (min(k, 19) if name == "trim" else k) and list(got) == sorted(got)


def test_kernels_without_texts():
    for name in V.KERNELS:
        assert len(V.KERNELS[name](X, np.zeros((0, 6)), 4)) == 4


def test_keep_count_truncates():
    assert [V.keep_count(576, r) for r in (0.222, 0.111, 0.056, 1)] == [127, 63, 32, 576]


def test_merge_keeps_and_adds_one():
    a = np.r_[np.full(20, 0.1), np.full(4, 5.0)]
    kept, merged = V.merge_tokens(X, a, 3)
    assert len(merged) == len(kept) + 1 and set(kept) == {20, 21, 22, 23}
    assert len(V.merge_tokens(X, a, 3, spaced=True)[0]) > len(kept)


def test_pad_and_collapse(spark):
    assert V.pad([np.ones((1, 2)), np.ones((3, 2))]).shape == (2, 3, 2)
    df = spark.createDataFrame([([9, 9, 1, 9, 9, 2, 2],), ([],), (None,)], "t array<int>")
    assert [r.c for r in df.select(V.collapse_runs(F.col("t"), 9).alias("c")).collect()] == [[9, 1, 9, 2, 2], [], None]


def test_expressions_and_selection(spark):
    df = spark.createDataFrame([(i, i % 2, i < 4, [float(v) for v in X[i]]) for i in range(24)], "id int, g int, is_text boolean, v array<double>")
    got = V.select_vectors(df, "g", "id", "v", "cd", 0.5, "is_text").groupBy("g").count().collect()
    assert {r["count"] for r in got} == {5}
    assert V.select_vectors(df, "g", "id", "v", "cd", 1.0).count() == 24
    zero = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert zero.select(V.cosine(F.col("a"), F.col("b")).alias("c")).first().c == 0.0


MERGE = {"merge": lambda x, t, k: V.merge_tokens(x, V.mean_cosine(x, t), 8)[0]}


@pytest.mark.parametrize("name", sorted(V.KERNELS | MERGE))
def test_kernels_hold_no_pairs_of_all_vectors(name):
    n, some = 3000, np.random.default_rng(1)
    x, t = some.normal(size=(n, 8)), some.normal(size=(300, 8))
    tracemalloc.start()
    got = (V.KERNELS | MERGE)[name](x, t, 40)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) and peak < n * n * 8 / 8


def rows_by_sql(sql, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    return sorted(con.execute(sql).fetchall())


@pytest.mark.parametrize("name", sorted(V.KERNELS))
def test_more_choices_than_dimensions_and_copies_match_sql(spark, name):
    some = np.random.default_rng(7)
    x = some.normal(size=(120, 6)).astype(np.float32)
    x[40:60] = x[39]
    rows = [(i, [float(v) for v in x[i]], i // 119) for i in range(120)]
    marked = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("is_text", F.col("vec_id") % 10 == 0)
    got = V.select_vectors(marked, "label", "vec_id", "embedding", name, 0.222, "is_text").collect()
    assert sorted(map(tuple, got)) == rows_by_sql(q.KERNEL_SQL[name], rows)


def dpp_by_whole_factor(x, weight, k):
    columns = V.columns_of(V.unit(x))
    left = weight * V.own_dots(columns) * weight
    factor, chosen = np.zeros((k, len(weight))), []
    for t in range(k):
        j = int(np.argmax(left))
        chosen.append(j)
        known = V.in_order(factor[s] * factor[s, j] for s in range(t))
        factor[t] = (weight[j] * V.fused_dots(columns, columns[:, j]) * weight - known) / np.sqrt(max(left[j], 1e-12))
        left -= factor[t] ** 2
        left[chosen] = -np.inf
    return sorted(chosen)


def vectors_to_choose_among(kind):
    some = np.random.default_rng(11)
    if kind == "copies":
        return np.tile(some.normal(size=(40, 6)), (20, 1))
    if kind == "orthogonal":  # differences that do not fit four bytes
        return some.choice([-1.0, 1.0], size=(500, 16))
    return some.normal(size=(900, 6)).astype(np.float32).astype(float)


@pytest.mark.parametrize("many_wide", [0, 10_000])
@pytest.mark.parametrize("kind", ["any", "copies", "orthogonal"])
def test_dpp_beyond_its_rank_equals_the_whole_factor(monkeypatch, kind, many_wide):
    for name, value in {"SLOTS": 16, "SUM_SLOTS": 3, "SUM_STEPS": 7, "PAIR_ROWS": 5, "MANY_WIDE": many_wide}.items():
        monkeypatch.setattr(V, name, value)
    x = vectors_to_choose_among(kind)
    weight = V.scaled(np.random.default_rng(12).normal(size=len(x)))
    assert list(V.greedy_dpp(x, weight, 250)) == dpp_by_whole_factor(x, weight, 250)


def test_dpp_beyond_its_rank_holds_no_whole_factor():
    n, k = 4000, 880
    x = np.random.default_rng(13).normal(size=(n, 8))
    tracemalloc.start()
    got = V.greedy_dpp(x, np.ones(n), k)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == k and peak < n * k * 8 / 2


def test_fused_dots_round_once():
    def chain(a, b):
        total = 0.0
        for x, y in zip(a.tolist(), b.tolist()):
            total = float(Fraction(x) * Fraction(y) + Fraction(total))
        return total

    some = np.random.default_rng(14)
    for n in (0, 1, 2, 3, 17):
        a, b = some.normal(size=(9, n)), some.normal(size=9)
        assert V.fused_dots(a, b).tolist() == V._by_parts(a, b, (n,)).tolist() == [chain(c, b) for c in a.T]
        assert V.own_dots(a).tolist() == [chain(c, c) for c in a.T]
        pairs = V.fused_dots(a[:, None, :], a[:, :, None])
        assert pairs.tolist() == [[chain(c, d) for d in a.T] for c in a.T]


def test_cd_takes_no_products_of_matrices(monkeypatch):
    """Their order and rounding differ from processor to processor."""
    monkeypatch.setattr(V, "row_dots", lambda columns, v: V.in_order(columns * v[:, None]))
    some = np.random.default_rng(7)
    x = some.normal(size=(120, 6)).astype(np.float32)
    x[40:60] = x[39]
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(120)]
    text = np.arange(120) % 10 == 0
    for fused in {V._complex_is_fused(), False}:
        monkeypatch.setattr(V, "_complex_is_fused", lambda fused=fused: fused)
        chosen = np.flatnonzero(~text)[V.conditional_dpp(x[~text].astype(float), x[text].astype(float), 23)]
        assert [(0, int(i), n) for n, i in enumerate(chosen)] == rows_by_sql(q.KERNEL_SQL["cd"], rows)


def test_each_group_has_a_task_of_its_own(spark):
    df = spark.createDataFrame([(i, i % 10, [float(i), 1.0]) for i in range(400)], "id int, g int, v array<double>").repartition(5)
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        tasks = V.select_vectors(df, "g", "id", "v", "div", 0.1).select(F.spark_partition_id().alias("task"))
        assert tasks.distinct().count() == 10
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def searched(spark):
    some = np.random.default_rng(9)
    x = np.round(some.normal(size=(300, 5)), 1)
    x[50:70] = x[0]  # copies: ties go to the smaller id
    x[7] = 0
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]] if i != 9 else None, i % 3) for i in range(300)], "id int, v array<double>, g int")
    return x, rows, rows.filter("id % 10 = 0").select(F.col("id").alias("q"), F.col("v").alias("qv"))


def test_nearest_meets_blocks_by_products(spark):
    x, rows, queries = searched(spark)
    u = V.unit(x)
    for limit in (V.BLOCK_BYTES, 500):  # whole, and in blocks
        df = V.nearest(queries, rows.filter("id <> 9").repartition(5), "q", "id", "qv", "v", 4, block_bytes=limit)
        assert "MapInArrow" in plan_of(df) and "NestedLoop" not in plan_of(df)
        got = sorted((r.q, r["rank"], r.id) for r in df.collect())
        want = [(q, n + 1, i) for q in range(0, 300, 10) for n, i in enumerate(sorted((i for i in range(300) if i != 9), key=lambda i: (-round(float(u[q] @ u[i]), 6), i))[:4])]
        assert got == want
    lone = V.nearest(queries.filter("q = 0"), rows.filter("id in (3, 9)"), "q", "id", "qv", "v", 4).collect()
    assert [(r.id, r.similarity is None) for r in sorted(lone, key=lambda r: r["rank"])] == [(3, False), (9, True)]


def test_relevance_and_distances_pair_no_rows(spark):
    x, rows, queries = searched(spark)
    u = V.unit(x)
    raw = -(u @ u[::10].T).mean(1)
    raw = np.delete(raw, 9)
    df = V.relevance(rows, queries, "id", "v", "qv")
    assert "posexplode" in plan_of(df)
    got = {r.id: r.relevance for r in df.collect()}
    assert got.pop(9) is None
    assert np.allclose([got[i] for i in sorted(got)], (raw - raw.min()) / (raw.max() - raw.min() + V.EPS))
    far = {r.id: r.distance for r in V.mean_squared_distance(rows, rows.filter("id % 10 = 0"), "g", "id", "v").collect()}
    for i in (0, 7, 55, 299):
        texts = [t for t in range(0, 300, 10) if t % 3 == i % 3]
        assert np.isclose(far[i], ((x[i] - x[texts]) ** 2).sum(1).mean())


def test_hash_vectors_hash_once():
    from promptloom.operators import embedding as e

    assert str(e.unit_array(e.HashEncoder().expression(F.col("x")))).count("md5") == 1


def test_prefilter_meets_blocks_by_products(spark, monkeypatch):
    from promptloom.functions.backends import HashBackend
    from promptloom.operators import semantic

    _, rows, queries = searched(spark)
    plain = rows.crossJoin(queries).filter(F.col("v").isNull() | F.col("qv").isNull() | (V.cosine(F.col("qv"), F.col("v")) >= 0.2))
    want = sorted((r.q, r.id) for r in plain.select("q", "id").collect())
    for limit in (semantic.BROADCAST_BYTES, 500):  # whole, and in blocks
        monkeypatch.setattr(semantic, "BROADCAST_BYTES", limit)
        close = semantic.Prefilter("qv", "v", 0.2, keep=False)
        df = semantic.sem_join(rows, queries, "{q} {id}", HashBackend(), choices=("Yes",), prefilter=close)
        assert "MapInArrow" in plan_of(df) and not {"v", "qv"} & set(df.columns)
        assert sorted((r.q, r.id) for r in df.collect()) == want
    kept = semantic.sem_join(rows, queries, "{q} {id}", HashBackend(), choices=("Yes",), prefilter=semantic.Prefilter("v", "qv", 0.2))
    assert kept.columns == ["id", "v", "g", "q", "qv"] and kept.count() == len(want)


def test_loneliest_compares_equal_vectors_once(monkeypatch):
    x = np.tile(np.random.default_rng(6).normal(size=(5, 8)), (40, 1))
    columns = V.columns_of(V.unit(x))
    plain = int(np.argmin([np.delete(V.row_dots(columns, columns[:, i]), i).max() for i in range(len(x))]))
    calls, dots = [], V.row_dots
    monkeypatch.setattr(V, "row_dots", lambda c, v: calls.append(1) or dots(c, v))
    assert V.loneliest(columns) == plain and len(calls) <= 5
