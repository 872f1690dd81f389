from collections import OrderedDict

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptloom.operators import cachesim, grouping, scoring, tokens
from promptloom.plans import benchmarks, context
from promptloom.functions.backends import HashBackend, RecordedBackend
from promptloom.sources import io


def test_sources_and_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b'), (2, None)], "i int, t string")
    io.write_csv(df, f"{tmp_path}/c", sep=";", single_file=True)
    assert io.read_csv(spark, f"{tmp_path}/c", sep=";").orderBy("i").collect()[0].t == 'a "q", b'
    io.write_json(df, f"{tmp_path}/j")
    assert io.read_json_lines(spark, f"{tmp_path}/j", "i int, t string").count() == 2
    io.write_parquet(df, f"{tmp_path}/p", ["i"])
    assert io.read_parquet(spark, f"{tmp_path}/p").count() == 2
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    assert io.read_json_array(spark, f"{tmp_path}/a.json").count() == 2
    (tmp_path / "y.yml").write_text("a: [1, 2]")
    assert io.read_yaml(f"{tmp_path}/y.yml") == {"a": [1, 2]}
    (tmp_path / "images").mkdir()
    (tmp_path / "images" / "im.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big"))
    files = io.read_files(spark, f"{tmp_path}/images", "*.png")
    got = io.with_file_bytes(spark.createDataFrame([("d/im.png",), ("d/no.png",)], "path string"), files, "path").orderBy("path").collect()
    assert got[0].content is not None and got[1].content is None
    for folder in ("u", "v"):
        (tmp_path / "images" / folder).mkdir()
        (tmp_path / "images" / folder / "x.png").write_bytes(folder.encode())
    both = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{tmp_path}/images").select("path", "content")
    named = spark.createDataFrame([("v/x.png",), (f"{tmp_path}/images/u/x.png",), (f"file:{tmp_path}/images/v/x.png",), ("x.png",), (None,), ("",)], "path string")
    got = {r.path: r.content and bytes(r.content) for r in io.with_file_bytes(named, both, "path").collect()}
    assert got == {"v/x.png": b"v", f"{tmp_path}/images/u/x.png": b"u", f"file:{tmp_path}/images/v/x.png": b"v", "x.png": b"u", None: None, "": None}
    assert io.with_file_bytes(named, both, "path").count() == 6
    w, h = tokens.png_size(F.col("content"))
    assert files.select(w.alias("w"), h.alias("h")).first() == (640, 480)


def test_table_chores(spark):
    df = io.from_pandas(spark, __import__("pandas").DataFrame({"Unnamed: 0": [0, 1], "t": ["a", None]}))
    assert [r.t for r in io.clean(df).collect()] == ["a", ""]
    many = spark.range(103)
    parts = io.ordered_split(many, ["id"], 4).groupBy("part").agg(F.count("*").alias("n"), F.min("id").alias("m")).orderBy("part").collect()
    assert [(r.n, r.m) for r in parts] == [(25, 0), (25, 25), (25, 50), (28, 75)]
    a, b = [[r.id for r in io.shuffled(many, "id").collect()] for _ in range(2)]
    assert a == b and a != sorted(a) and sorted(a) == list(range(103))
    io.register_views(some_view=many)
    assert "some_view" in io.table_names(spark)


def test_grouping(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), (None, 3, "c")], "k string, o int, q string")
    got = {r.k: r.guidance for r in grouping.guidance(df, "k", "q", "o").collect()}
    assert got["k"].endswith('"a", "b"')

    def encode(v):
        if v == "c":
            raise ValueError("no")
        return len(v)

    rows = {r.o: (r.encoded, r.status) for r in grouping.encode_once(df, "k", encode, "q", "int").collect()}
    assert rows[1] == (1, "ok") and rows[2] == (1, "ok") and rows[3][0] is None and rows[3][1].startswith("ValueError")


def test_scores(spark):
    df = spark.createDataFrame([("i,1", "Yes", " yes "), ("i,2", "No", "yes"), ("j", "No", "no"), ("k", "Yes", None)], "question_id string, answer string, predicted string")
    m = scoring.mme(df).first()
    assert (m.images, m.questions, m.correct, m.images_correct, m.tp, m.tn, m.fp, m.fn) == (3, 4, 2, 1, 1, 1, 1, 0)
    assert scoring.accuracy(df.limit(0).withColumn("is_correct", F.lit(1))).first().accuracy == 0.0
    v = spark.createDataFrame([(1.0,), (1.0,), (float("nan"),), (None,), (5.0,)], "v double")
    assert [(r.value, round(r.share, 3)) for r in scoring.cdf(v, "v").orderBy("value", "share").collect()] == [(1.0, 0.333), (1.0, 0.667), (5.0, 1.0)]
    x = np.r_[np.arange(20.0), 500]
    got = scoring.outlier_share(spark.createDataFrame([(float(i),) for i in x], "v double"), "v").first().ratio
    assert got == pytest.approx(1 / 21)


def test_quantiles_by_group(spark):
    rnd = np.random.default_rng(5)
    rows = [(None if g == 2 else g, float(v)) for g in range(3) for v in rnd.integers(0, 9, 1 + 10 * g)] + [(7, None)]
    got = {r.g: r.q for r in scoring.quantiles(spark.createDataFrame(rows, "g int, v double"), ["g"], "v", [0.25, 0.5, 1.0]).collect()}
    for g in (None, 0, 1):
        assert got[g] == pytest.approx(list(np.percentile([v for h, v in rows if h == g], [25, 50, 100])))
    assert 7 not in got
    summary = {r.g: r.median for r in scoring.timing_summary(spark.createDataFrame(rows, "g int, v double"), ["v"], ["g"]).collect()}
    assert summary[7] is None and summary[1] == pytest.approx(np.median([v for h, v in rows if h == 1]))


def test_scratch_tables_go(spark):
    import os

    from promptloom import shared

    with shared.scratch(spark):
        inner = shared.stash(spark.range(3), "t")
        kept = shared.stash(inner, "t", outlive=True)
        path = inner.inputFiles()[0]
    assert not os.path.exists(path.removeprefix("file://")) and kept.count() == 3
    assert shared.small(spark.range(3), 100) and not shared.small(spark.range(1000), 100)


def test_any_resolution(spark):
    from promptloom.functions import anyres

    tiles = [(336, 672), (672, 336), (672, 672)]
    sizes = [(100, 100), (336, 672), (2000, 300), (301, 2999), (672, 672), (5, 900), (0, 10), (None, 4)]
    df = spark.createDataFrame(sizes, "w long, h long")
    w, h = F.col("w"), F.col("h")
    got = {(r.w, r.h): r for r in df.select("w", "h", anyres.best_resolution(w, h, tiles).alias("best"), anyres.token_count(w, h, tiles, 336, 14).alias("n")).collect()}
    for x, y in sizes[:-2]:
        def rated(t, x=x, y=y):
            scale = min(t[0] / x, t[1] / y)
            kept = min(int(x * scale) * int(y * scale), x * y)
            return kept, kept - t[0] * t[1]

        best = max(tiles, key=rated)
        assert tuple(got[x, y].best) == best
        mask = np.zeros((best[1] // 14, best[0] // 14), bool)  # which cells of the map are no margin
        if x * mask.shape[0] > y * mask.shape[1]:
            margin = (mask.shape[0] - y * mask.shape[1] // x) // 2
            mask[margin : mask.shape[0] - margin] = True
            rows = mask.shape[0] - 2 * margin
        else:
            margin = (mask.shape[1] - x * mask.shape[0] // y) // 2
            mask[:, margin : mask.shape[1] - margin] = True
            rows = mask.shape[0]
        assert got[x, y].n == 576 + mask.sum() + rows
    assert got[0, 10].best is None and got[None, 4].n is None


class Model:
    """The cache's rules again, on one ordered dict."""

    def __init__(self, capacity):
        self.capacity, self.free, self.used = capacity, OrderedDict(), {}

    def request(self, k, t):
        if k in self.used or k in self.free:
            self.used[k] = self.used.get(k) or self.free.pop(k)
            return "hit"
        if sum(self.used.values()) + t > self.capacity:
            return "rejected"
        while sum(self.used.values()) + sum(self.free.values()) + t > self.capacity:
            self.free.popitem(last=False)
        self.used[k] = t
        return "miss"

    def release(self, k):
        self.free[k] = self.used.pop(k)


def test_cache_against_a_model():
    rnd = np.random.default_rng(0)
    cache, model = cachesim.EncoderCache(30), Model(30)
    for i, k in enumerate(rnd.integers(0, 9, 400)):
        t = int(k) * 3 + 2
        a = cache.request(k, i, t)
        assert a == model.request(k, t)
        if a != "rejected":
            cache.free(k, i)
            model.release(k)
    assert cache.hits and cache.evictions
    assert cachesim.EncoderCache(30).request("a", 0, 20, budget=10) == "rejected"
    assert cachesim.budgets(100, 200, 50) == (200, 200)


def test_context_keeps_questions_without_documents(spark):
    q = spark.createDataFrame([("q1", "?", ["t2", "t1", "t9"], ["i1"], "tab"), ("q2", "?", [], None, None)], "qid string, question string, text_doc_ids array<string>, image_doc_ids array<string>, table_id string")
    t = spark.createDataFrame([("t1", "one"), ("t2", "two")], "id string, text string")
    i = spark.createDataFrame([("i1", "p.png")], "id string, path string")
    b = spark.createDataFrame([("tab", "{}")], "id string, table_json string")
    got = {r.qid: r for r in context.assemble(q, t, i, b).collect()}
    assert got["q1"].all_text_docs == "two" + context.SEPARATOR + "one" and got["q1"].image_paths == ["p.png"] and got["q1"].table_data == "{}"
    assert got["q2"].all_text_docs == context.NO_TEXT and got["q2"].image_paths == [] and got["q2"].table_data == context.NO_TABLE


def test_plans_and_sweep(spark):
    df = spark.createDataFrame([("q", "Yes", "x.png")], "question string, answer string, image string")
    plan = benchmarks.PLANS["pope"]
    prompt = "Given the question: q and image: [image], give me the answer to the question"
    assert benchmarks.ask(df, plan, RecordedBackend({prompt: " yes\n"})).first().is_correct == 1
    got = benchmarks.run_sweep(df, plan, {1.0: RecordedBackend({prompt: "Yes"}), 0.5: RecordedBackend({})}).collect()
    assert {r.keep_ratio: r.accuracy for r in got} == {1.0: 100.0, 0.5: 0.0}


def test_stream(spark, tmp_path):
    from promptloom.streaming.semantic_stream import sem_stream

    io.write_parquet(spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, t string"), f"{tmp_path}/in")
    stream = spark.readStream.schema("id int, t string").parquet(f"{tmp_path}/in")
    sink = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{tmp_path}/out/{batch}")
    sem_stream(stream, "is {t}?", "r", HashBackend(), sink, f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out/0").count() == 3
