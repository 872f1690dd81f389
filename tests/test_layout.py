import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from promptloom.operators import layout as L


def cells(table):
    return [(i, [(f"c{j}", v) for j, v in enumerate(r)]) for i, r in enumerate(table)]


tables = st.integers(1, 4).flatmap(lambda w: st.lists(st.lists(st.sampled_from(["a", "bb", "ccc", ""]), min_size=w, max_size=w), min_size=1, max_size=7))


@settings(max_examples=60, deadline=None)
@given(tables)
def test_greedy_is_a_permutation_of_each_rows_cells(table):
    rows = cells(table)
    out = L.greedy(rows)
    assert sorted(p for p, _ in out) == [p for p, _ in rows]
    assert all(sorted(c) == sorted(dict(rows)[p]) for p, c in out)


def plain_greedy(rows, least=0):
    """The greedy rule as a recursion: rows are (position, cells)."""
    if not rows:
        return []
    values = {v for _, cs in rows for _, v in cs}
    gain = {v: len(v) ** 2 * (sum(any(x == v for _, x in cs) for _, cs in rows) - 1) for v in values}
    value = min(values, key=lambda v: (-gain[v], v), default=None)
    if value is None or gain[value] <= least:
        width = len(rows[0][1])
        score = [sum(len(cs[j][1]) ** 2 for _, cs in rows) / len(rows) * (len(rows) / len({cs[j][1] for _, cs in rows}) - 1) for j in range(width)]
        order = sorted(range(width), key=lambda j: (-score[j], j))
        return sorted(((p, [cs[j] for j in order]) for p, cs in rows), key=lambda r: ([v for _, v in r[1]], r[0]))
    parts = {}
    for p, cs in rows:
        front = [c for c in cs if c[1] == value]
        if front:
            parts.setdefault(len(front), []).append((p, front, [c for c in cs if c[1] != value]))
    out = []
    for n in sorted(parts):
        fronts = {p: front for p, front, _ in parts[n]}
        out += [(p, fronts[p] + cs) for p, cs in plain_greedy([(p, rest) for p, _, rest in parts[n]], least)]
    return out + plain_greedy([(p, cs) for p, cs in rows if all(v != value for _, v in cs)], least)


@settings(max_examples=150, deadline=None)
@given(tables, st.sampled_from([0, 3, 9]))
def test_greedy_equals_a_plain_recursion(table, least):
    assert L.greedy(cells(table), least) == plain_greedy(cells(table), least)


def test_registered_layout_equals_a_plain_recursion(spark):
    from promptloom.plans import queries as q

    sf = "/root/testdata/sf0.001"
    got = q.QUERIES["ggr_layout"](spark, sf).collect()
    part = q.table(spark, sf, "part")
    stats = {r["column"]: r for r in L.column_stats(part, "p_brand", "p_type", "p_size", "p_name").collect()}
    order = sorted(stats, key=lambda c: (-stats[c]["score"], stats[c]["place"]))
    kept = [c for c in order if stats[c]["n_distinct"] <= 0.8 * stats[c]["n_rows"]]
    text = {r.p_partkey: {c: str(r[c]) for c in order} for r in part.collect()}
    for chunk in {r.chunk for r in got}:
        mine = sorted((r for r in got if r.chunk == chunk), key=lambda r: r.pos)
        keys = sorted((r.p_partkey for r in mine), key=lambda k: ([text[k][c] for c in kept], k))
        want = plain_greedy([(i, [(c, text[k][c]) for c in kept]) for i, k in enumerate(keys)], 100)
        rest = [c for c in order if c not in kept]
        assert [(r.p_partkey, [(x.name, x.value) for x in r.cells]) for r in mine] == [(keys[i], cs + [(c, text[keys[i]][c]) for c in rest]) for i, cs in want]
    assert sorted(r.p_partkey for r in got) == sorted(text)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "bb", "ccc"]), min_size=2, max_size=2), min_size=1, max_size=5))
def test_exhaustive_is_no_worse_than_any_single_column_sort(table):
    best, _ = L.best_small(cells(table))
    by_first = sum(len(v) ** 2 * (len(list(g)) - 1) for v, g in itertools.groupby(sorted(r[0] for r in table)))
    assert best >= by_first


def test_greedy_beats_the_input_order():
    rnd = random.Random(3)
    rows = cells([[rnd.choice(["red wine", "tea"]), str(i), rnd.choice(["long text " * 3, "other text"])] for i in range(60)])
    assert L.shared_weight(L.greedy(rows)) > 3 * L.shared_weight(rows)


def test_dependents_move_along():
    rows = [(i, [("id", str(i)), ("city", "Rome"), ("land", "IT")]) for i in range(3)]
    assert all([n for n, _ in c][:2] == ["city", "land"] for _, c in L.greedy(rows, depends={"city": ["land"]}))


def trie_hits(prompts):
    seen, hits = set(), 0
    for p in prompts:
        for k in range(1, len(p) + 1):
            hits += p[:k] in seen
            seen.add(p[:k])
    return hits


def test_prefix_hits_equal_a_trie(spark):
    rnd = random.Random(1)
    table = [("".join(rnd.choices("ab", k=rnd.randint(0, 4))), "".join(rnd.choices("ab", k=2))) for _ in range(40)]
    df = spark.createDataFrame(table, "x string, y string").repartition(4)
    got = L.char_hits(df, F.concat("x", "y")).first()
    assert got.hits == trie_hits([x + y for x, y in table])
    r = L.cell_hits(df, "x", "y").first()
    assert r.hits == sum(len(table) - len(s) for s in ({x for x, _ in table}, set(table)))


def test_empty_table(spark):
    df = spark.createDataFrame([], "x string, y string")
    assert L.column_stats(df).count() == 0 and L.char_hits(df, F.col("x")).count() == 1
    assert L.greedy_layout(df.withColumn("k", F.lit(1)), "k", "x").count() == 0


def test_nulls_and_booleans(spark):
    df = spark.createDataFrame([(None, True), ("ab", None), ("ab", False)], "x string, b boolean")
    stats = {r["column"]: r for r in L.column_stats(df).collect()}
    assert stats["x"].n_distinct == 2 and stats["b"].n_rows == 3


def test_dependency_groups_and_merge(spark):
    df = spark.createDataFrame([(1, "a", "u", "k"), (2, "b", "v", "k"), (1, "a", "u", "m")], "i int, n string, l string, o string")
    pairs = [(r.a, r.b) for r in L.dependencies(df).collect()]
    assert sorted(pairs) == [("i", "l"), ("i", "n"), ("n", "l")]
    groups = L.dependency_groups(pairs)
    assert sorted(map(sorted, groups)) == [["i", "l", "n"]]
    assert L.merge_columns(df, [["i", "n"], ["l", "o"]]).columns == ["i_n", "l_o"]


def test_layout_chunks_keep_all_rows(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).cast("string").alias("a"), F.col("id").cast("string").alias("u"))
    got = L.greedy_layout(df, "id", chunk_rows=100).collect()
    assert sorted(r.id for r in got) == list(range(500)) and all(r.cells[-1].name == "u" for r in got)
