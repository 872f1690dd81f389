import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pandas as pd
import pytest
from pyspark.sql import functions as F

from promptloom.functions import templates as tp
from promptloom.functions import text as tx
from promptloom.functions.backends import CountingBackend, HashBackend, HttpBackend, RecordedBackend, backend
from promptloom.operators import semantic as sem


def counting(spark, inner):
    calls = spark.sparkContext.accumulator(0)
    return CountingBackend(inner, calls), calls


def rows(spark):
    return spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "x"), (4, None, "x")], "id int, t string, u string")


def test_fields_and_places():
    assert tp.fields("{text:a} {image:b} {c} {a}") == [("a", "text"), ("b", "image"), ("c", "text")]
    assert tp.places("{a}{b}{a}") == ["a", "b", "a"]


def test_render_binds_by_name_and_checks(spark):
    df = rows(spark)
    got = [r.p for r in df.orderBy("id").select(tp.render(df, "T={t} U={text:v}.", {"v": "u"}).alias("p")).collect()]
    assert got == ["T=a U=x.", "T=a U=y.", "T=b U=x.", "T=None U=x."]
    with pytest.raises(ValueError):
        tp.render(df, "{t}", {"zz": "u"})
    with pytest.raises(ValueError):
        tp.render(df, "{nothing}")


def test_nested_cells_are_json_and_system_prefix(spark):
    df = spark.createDataFrame([(["p", "q"],)], "xs array<string>")
    assert df.select(tp.render(df, "{xs}", system="S").alias("p")).first().p == 'S\n\n["p","q"]'


def test_python_and_jvm_hash_agree(spark):
    df = rows(spark)
    b = HashBackend(("A", "B", "C"))
    jvm = sem.sem_map(df, "{t}{u}", "r", b).orderBy("id").collect()
    py, _ = counting(spark, b)
    assert [r.r for r in sem.sem_map(df, "{t}{u}", "r", py).orderBy("id").collect()] == [r.r for r in jvm]


def test_dedup_asks_equal_prompts_once(spark):
    df = rows(spark).union(rows(spark)).coalesce(1)
    b, calls = counting(spark, HashBackend())
    assert sem.sem_map(df, "is {t}?", "r", b).count() == 8
    out = sem.sem_map(df, "is {t}?", "r", b).collect()
    assert len(out) == 8 and calls.value == 3
    b, calls = counting(spark, HashBackend())
    assert len(sem.sem_map(df, "is {t}?", "r", b, dedup=False).collect()) == 8 and calls.value == 8


def test_cascade_short_circuits_and_order_does_not_matter(spark):
    df = spark.range(200).select(F.col("id"), (F.col("id") % 10).alias("m"))
    steps = [sem.Step("one {id}"), sem.Step("two {id}"), sem.Step(condition=F.col("m") < 5)]
    first = {r.id for r in sem.cascade(df, steps, HashBackend()).collect()}
    second = {r.id for r in sem.cascade(df, steps[::-1], HashBackend(), reorder=False).collect()}
    assert first == second and 0 < len(first) < 100
    b, calls = counting(spark, HashBackend())
    sem.cascade(df, steps, b).collect()
    passed = sem.sem_filter(df.filter("m < 5"), "one {id}", HashBackend()).count()
    assert calls.value == 100 + passed


@pytest.mark.parametrize("steps", [4, 6])
def test_long_cascades_ask_each_prompt_once(spark, steps):
    df = spark.range(60).select(F.col("id"))
    b, calls = counting(spark, HashBackend())
    assert sem.cascade(df, [sem.Step(f"step {k} of {{id}}", choices=("Yes",)) for k in range(steps)], b).count() == 60
    assert calls.value == 60 * steps
    b, calls = counting(spark, HashBackend())
    left, due = df, 0
    for k in range(steps):
        due += left.count()
        left = sem.sem_filter(left, f"step {k} of {{id}}", HashBackend())
    got = sem.cascade(df, [sem.Step(f"step {k} of {{id}}") for k in range(steps)], b).collect()
    assert {r.id for r in got} == {r.id for r in left.collect()} and calls.value == due


def test_columns_of_replies_are_asked_once_each(spark):
    b, calls = counting(spark, HashBackend())
    df = spark.range(20)
    for k in range(4):
        df = sem.sem_map(df, f"column {k} of {{id}}", f"c{k}", b)
    assert len(df.collect()) == 20 and calls.value == 80


def test_wide_tables_of_replies_are_asked_once(spark):
    b, calls = counting(spark, HashBackend())
    df = spark.range(4).select("id", *[F.lit(k).alias(f"x{k}") for k in range(60)])
    for k in range(4):
        df = sem.sem_map(df, f"column {k} of {{id}}", f"c{k}", b)
    assert len(df.collect()) == 4 and calls.value == 16


def test_plan_cascade_puts_cheap_selective_first(spark):
    df = spark.range(50)
    steps = [sem.Step("a {id}", cost=5, keeps=0.5, name="a"), sem.Step("b {id}", cost=1, keeps=0.1, name="b"), sem.Step(condition=F.col("id") > 3, name="c")]
    assert [s.name for s in sem.plan_cascade(df, steps, HashBackend())] == ["c", "b", "a"]
    assert len(sem.plan_cascade(df, [sem.Step("a {id}"), sem.Step("b {id}")], HashBackend(), sample_rows=20)) == 2


@pytest.mark.parametrize("how,n", [("inner", 2), ("left", 3), ("semi", 1), ("anti", 2)])
def test_semantic_joins(spark, how, n):
    a = spark.createDataFrame([("p",), ("q",), (None,)], "x string")
    b = spark.createDataFrame([("s",), ("t",)], "y string")
    said = RecordedBackend({"p-s": "Yes", "p-t": "Yes", "q-s": "No"})
    expected = {"inner": 2, "left": 4, "semi": 1, "anti": 2}[how]
    assert sem.sem_join(a, b, "{x}-{y}", said, how=how).count() == expected
    assert n <= expected


@pytest.mark.parametrize("how", ["inner", "left", "semi", "anti"])
@pytest.mark.parametrize("conditional", [False, True])
def test_semantic_joins_of_rows_that_repeat(spark, how, conditional):
    left, right = ["p", "p", "q", None, None], ["s", "s", "t"]
    a, b = spark.createDataFrame([(x, 1) for x in left], "x string, one int"), spark.createDataFrame([(y, 1) for y in right], "y string, uno int")
    yes = {("p", "s"), ("p", "t"), ("None", "t")}
    said = RecordedBackend({f"{x}-{y}": "Yes" for x, y in yes})
    pairs = [(x, y) for x in left for y in right if (x or "None", y) in yes]
    matched = {x for x, _ in pairs}
    want = {"inner": pairs, "left": pairs + [(x, None) for x in left if x not in matched], "semi": [x for x in left if x in matched], "anti": [x for x in left if x not in matched]}[how]
    backend_, calls = counting(spark, said)
    got = sem.sem_join(a, b, "{x}-{y}", backend_, on=F.col("one") == F.col("uno") if conditional else None, how=how).collect()
    key = lambda r: repr(r)
    assert sorted([(r.x, r.y) if how in ("inner", "left") else r.x for r in got], key=key) == sorted(want, key=key)
    assert calls.value == 6  # three different left rows and two right ones


def test_a_large_right_side_is_paired_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(sem, "BROADCAST_BYTES", 40)
    a, b = spark.range(5).select(F.col("id").alias("x")), spark.range(9).select(F.col("id").alias("y"))
    said = RecordedBackend({f"{x}-{y}": "Yes" for x in range(5) for y in range(x)})
    got = sem.sem_join(a, b, "{x}-{y}", said)
    assert {(r.x, r.y) for r in got.collect()} == {(x, y) for x in range(5) for y in range(x)}


def test_reply_status(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "p string")
    got = {r.p: (r.r, r.s) for r in sem.infer(df, "p", "r", RecordedBackend({"a": "1"}), status="s").collect()}
    assert got == {"a": ("1", "ok"), "b": (None, "failed"), None: (None, "no prompt")}
    assert sem.sem_map(df.limit(1), "{p}", "r", HashBackend(), status="s").first().s == "ok"


def test_sql_function_asks_equal_prompts_once(spark):
    rows(spark).union(rows(spark)).coalesce(1).createOrReplaceTempView("t_twice")
    b, calls = counting(spark, RecordedBackend({"a": "1", "b": "2"}))
    sem.register_llm(spark, b, "LLM_ONCE")
    got = [r.r for r in spark.sql("SELECT LLM_ONCE('{t}', t) AS r FROM t_twice").collect()]
    assert sorted(x or "" for x in got) == ["", "", "1", "1", "1", "1", "2", "2"] and calls.value == 3


def test_prefilter_skips_far_pairs_and_asks_without_embedding(spark):
    a = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], "x int, ex array<double>")
    b = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.0, 1.0])], "y int, ey array<double>")
    backend_, calls = counting(spark, RecordedBackend({f"{i} {j}": "Yes" for i in (1, 2, 3) for j in (1, 2)}))
    got = {(r.x, r.y) for r in sem.sem_join(a, b, "{x} {y}", backend_, prefilter=sem.Prefilter("ex", "ey")).collect()}
    assert got == {(1, 1), (2, 1), (2, 2)} and calls.value == 3


def test_average_leaves_out_what_is_no_number(spark):
    df = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "c")], "k string, t string")
    got = {r.k: r.average for r in sem.sem_agg(df, ["k"], "{t}", RecordedBackend({"a": "4", "b": "none", "c": "x"})).collect()}
    assert got == {"g": 4.0, "h": None}


def test_sql_function_forms(spark):
    rows(spark).createOrReplaceTempView("t_sql")
    said = RecordedBackend({"a of x": "1", "a of y": "2", "b of x": "3", "None of x": "4"})
    sem.register_llm(spark, said)
    for call in ("LLM('{text:t} of {u}', t, u)", "LLM('{text:t} ', 'of {u}', t, u)", "LLM('{t} of {u}', u => u, t => t)", "LLM('{t} of {u}', named_struct('u', u, 't', t))"):
        got = [r.r for r in spark.sql(f"SELECT {call} AS r FROM t_sql ORDER BY id").collect()]
        assert got == ["1", "2", "3", "4"], call
    with pytest.raises(Exception, match="2 fields"):
        spark.sql("SELECT LLM('{t} of {u}', t, u, u) AS r FROM t_sql").collect()


def test_rendered_rows_reads_the_template_per_row():
    got = sem.rendered_rows(pd.Series(["a{x}", "b{x}"]), [pd.Series([1, 2])], {}, "None")
    assert got == ["a1", "b2"]


class Stub(BaseHTTPRequestHandler):
    bodies: list = []
    busy = 0

    def do_GET(self):
        self._say({"data": []})

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Stub.bodies.append(body)
        if Stub.busy:
            Stub.busy -= 1
            self.send_response(503)
            self.end_headers()
            return
        if self.path.endswith("/chat/completions"):
            text = body["messages"][0]["content"][0]["text"]
            self._say({"choices": [{"message": {"content": text.upper()}}]} if text != "bad" else {"oops": 1})
        else:
            self._say({"choices": [{"text": p + "!"} for p in body["prompt"]]})

    def _say(self, x):
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(x).encode())

    def log_message(self, *_):
        pass


def test_http_backend_keeps_order_and_isolates_failures():
    server = HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/v1"
        b = HttpBackend(url, "m")
        assert b.alive()
        assert b.complete(["a", "bad", None, "c"], [None] * 4) == ["A", None, None, "C"]
        assert HttpBackend(url, "m", chunk=2).complete(["a", "b", "c"], [None] * 3) == ["a!", "b!", "c!"]
        Stub.bodies.clear()
        mixed = HttpBackend(url, "m", chunk=3).complete(["a", None, "b", "c", "d"], [["x"], None, ["y"], ["x"], ["x"]], images=[None, None, None, None, "e"])
        assert mixed == ["a!", None, "b!", "c!", "D"]
        assert {tuple(x["prompt"]): x["guided_choice"] for x in Stub.bodies if "prompt" in x} == {("a", "c"): ["x"], ("b",): ["y"]}
        assert [x["messages"][0]["content"][1]["image_embeds"] for x in Stub.bodies if "messages" in x] == ["e"]
        Stub.busy = 2
        assert HttpBackend(url, "m", backoff=0.01).complete(["a"], [None]) == ["A"]
        Stub.busy = 2
        assert HttpBackend(url, "m", retries=1, backoff=0.01).complete(["a"], [None]) == [None]
    finally:
        server.shutdown()
    assert not HttpBackend("http://127.0.0.1:9/v1", "m").alive()
    sent = b.payload("p", ["Yes"], {"type": "object"}, "e")
    assert sent["guided_choice"] == ["Yes"] and sent["guided_json"] == {"type": "object"} and sent["messages"][0]["content"][1]["image_embeds"] == "e"


def test_backend_registry():
    assert isinstance(backend("hash"), HashBackend)
    with pytest.raises(ValueError):
        backend("none")


def test_text_helpers(spark):
    df = spark.createDataFrame([("['a b', 'c']", "x, y", "50%"), (None, None, None)], "lit string, com string, t string")
    r = df.select(tx.options(F.col("lit")).alias("a"), tx.options(F.col("com")).alias("b"), tx.answer_index(F.lit(" Y "), tx.options(F.col("com"))).alias("i")).collect()
    assert (r[0].a, r[0].b, r[0].i) == (["a b", "c"], ["x", "y"], 1)
    assert (r[1].a, r[1].b, r[1].i) == (None, None, -1)
    img = spark.createDataFrame([([(bytearray(b"z"), "p.png")],)], "im array<struct<bytes: binary, path: string>>")
    got = img.select(tx.image_bytes(img, "im").alias("b"), tx.image_path(img, "im").alias("p")).first()
    assert bytes(got.b) == b"z" and got.p == "p.png"
    nested = spark.createDataFrame([(["a", "b"], None)], "xs array<string>, s string")
    assert nested.select(tx.flatten_text(nested, "xs").alias("x"), tx.flatten_text(nested, "s").alias("s")).first() == ("a b", "")


def test_embeddings(spark):
    from promptloom.operators.embedding import HashEncoder, embed

    class Failing:
        dims = 2

        def encode(self, values):
            if "bad" in values:
                raise ValueError("no")
            return [[3.0, 4.0] for _ in values]

    df = spark.createDataFrame([("a",), ("bad",), ("",), (None,)], "t string").coalesce(1)
    got = {r.t: [round(x, 3) for x in r.t_embedding] for r in embed(df, "t", Failing()).collect()}
    assert got == {"a": [0.6, 0.8], "bad": [0.0, 0.0], "": [0.0, 0.0], None: [0.0, 0.0]}
    v = embed(df.filter("t = 'a'"), "t", HashEncoder()).first().t_embedding
    assert abs(sum(x * x for x in v) - 1) < 1e-5


def test_images_reach_the_backend_by_row(spark):
    class Seeing:
        def complete(self, prompts, choices, json_schema=None, images=None):
            return [f"{p}/{i}" for p, i in zip(prompts, images or [None] * len(prompts), strict=True)]

    df = spark.createDataFrame([("p", "i1"), ("p", "i2"), ("q", None)], "prompt string, image string")
    for dedup in (True, False):
        got = sorted(r.r for r in sem.infer(df.coalesce(1), "prompt", "r", Seeing(), dedup=dedup, image_col="image").collect())
        assert got == ["p/i1", "p/i2", "q/None"]
