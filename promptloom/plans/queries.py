"""The registered queries over the engine's operators, and their SQL for DuckDB.

Replies come from the hash backend, so the SQL can state both the expected prompt, on its
own, and the expected reply.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptloom.functions import anyres
from promptloom.functions import templates as tp
from promptloom.functions import text as tx
from promptloom.functions.backends import YES_NO, HashBackend, RecordedBackend
from promptloom.operators import cachesim, embedding, grouping, layout, scoring, semantic, tokens, vectors
from promptloom.plans import benchmarks, context
from promptloom.shared import temporary_path
from promptloom.sources import io

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return io.read_parquet(spark, f"{sf_dir}/{name}.parquet")


def pick(prompt: str, *choices: str) -> str:
    """SQL for the hash backend's reply."""
    listed = ", ".join(f"'{c}'" for c in choices)
    return f"[{listed}][('0x' || substr(md5({prompt}), 1, 8))::BIGINT % {len(choices)} + 1]"


SCORES = ("0", "1", "2", "3", "4", "5")
COUNTRY = "Is {text:c_name} in {text:n_name}?"
COUNTRY_SQL = "'Is ' || c_name || ' in ' || n_name || '?'"
JOINED = "customer JOIN nation ON c_nationkey = n_nationkey"


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"])


# ---- semantic operators


@query(f"SELECT c_custkey, {pick(COUNTRY_SQL, 'Yes', 'No')} AS reply FROM {JOINED}")
def sem_map(spark, sf_dir):
    return semantic.sem_map(customers(spark, sf_dir), COUNTRY, "reply", HashBackend()).select("c_custkey", "reply")


@query(f"SELECT c_custkey, n_name FROM {JOINED} WHERE {pick(COUNTRY_SQL, 'Yes', 'No')} = 'Yes'")
def sem_filter(spark, sf_dir):
    return semantic.sem_filter(customers(spark, sf_dir), COUNTRY, HashBackend()).select("c_custkey", "n_name")


@query(f"SELECT c_custkey, {pick(COUNTRY_SQL, 'Yes', 'No')} AS first, {pick("'Segment ' || c_mktsegment || ' of ' || c_name", 'A', 'B', 'C')} AS second FROM {JOINED}")
def sem_multi_llm(spark, sf_dir):
    one = semantic.sem_map(customers(spark, sf_dir), COUNTRY, "first", HashBackend())
    two = semantic.sem_map(one, "Segment {segment} of {text:c_name}", "second", HashBackend(("A", "B", "C")), bindings={"segment": "c_mktsegment"})
    return two.select("c_custkey", "first", "second")


@query("SELECT p_partkey, string_split(p_name, ' ')[('0x' || substr(md5('Which word names ' || p_brand || '?'), 1, 8))::BIGINT % len(string_split(p_name, ' ')) + 1] AS reply FROM part")
def sem_case_choices(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumn("options", F.split("p_name", " "))
    return semantic.sem_map(parts, "Which word names {text:p_brand}?", "reply", HashBackend(), choices_col="options").select("p_partkey", "reply")


@query("SELECT o_orderkey, 'Be brief.' || chr(10) || chr(10) || 'o_orderstatus: ' || o_orderstatus || chr(10) || 'o_orderpriority: ' || o_orderpriority || chr(10) || 'photo: [image]' AS prompt FROM orders")
def sem_render_fields(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("photo", F.lit("x.png"))
    prompt = tp.render_fields(orders, "{text:o_orderstatus} {text:o_orderpriority} {image:photo}", system="Be brief.")
    return orders.select("o_orderkey", prompt.alias("prompt"))


@query("""SELECT o_orderkey, 'Given the following data:' || chr(10) || ' {"o_orderkey":"' || o_orderkey || '","o_orderpriority":"' || o_orderpriority || '"} ' || chr(10) || ' answer the below query:' || chr(10) || 'Is it urgent?' AS prompt,
 'Answer the below query:' || chr(10) || chr(10) || 'Is it urgent?' || chr(10) || chr(10) || 'given the following data:' || chr(10) || chr(10) || '{"o_orderstatus":"' || o_orderstatus || '"}' AS row_prompt FROM orders""")
def sem_render_json(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", tp.render_json(orders, "Is it urgent?", ["o_orderkey", "o_orderpriority"]).alias("prompt"), tp.render_json(orders, "Is it urgent?", ["o_orderstatus"], single_row=True).alias("row_prompt"))


@query("SELECT p_partkey, array_to_string(list_transform(range(1, len(string_split(p_name, ' ')) + 1), lambda i: 'view_' || i || ': [image]'), chr(10)) AS lines FROM part")
def sem_render_multi_image(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tp.image_lines("view", F.split("p_name", " ")).alias("lines"))


@query("""SELECT event_id, event_type || CASE event_type WHEN 'click' THEN chr(10) || chr(10) || 'REMEMBER: Your answer must be concise and direct, with no explanatory text.'
 WHEN 'view' THEN chr(10) || chr(10) || 'REMEMBER: Your entire answer must be EXACTLY ''Yes'' or ''No'' - nothing more, nothing less.' ELSE '' END AS prompt FROM events""")
def sem_instruction(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", tp.OPEN_KINDS[0]).when(F.col("event_type") == "view", tp.BINARY_KINDS[0])
    return table(spark, sf_dir, "events").select("event_id", F.concat("event_type", tp.instruction(kind, F.lit(0))).alias("prompt"))


SUPPLIER_REGION = "Does {text:s_name} ship to {text:r_name}?"
SUPPLIER_REGION_SQL = "'Does ' || s_name || ' ship to ' || r_name || '?'"


@query(f"SELECT s_suppkey, r_name FROM supplier, region WHERE {pick(SUPPLIER_REGION_SQL, 'Yes', 'No')} = 'Yes'")
def sem_join_cross(spark, sf_dir):
    return semantic.sem_join(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "region"), SUPPLIER_REGION, HashBackend()).select("s_suppkey", "r_name")


def _supplier_nation(spark, sf_dir, how):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return semantic.sem_join(s, n, "Is {text:s_name} in {text:n_name}?", HashBackend(), on=s["s_nationkey"] == n["n_nationkey"], how=how)


SUPPLIER_MATCH = f"SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE {pick("'Is ' || s_name || ' in ' || n_name || '?'", 'Yes', 'No')} = 'Yes'"


@query(f"SELECT s.s_suppkey, m.n_name FROM supplier s LEFT JOIN ({SUPPLIER_MATCH}) m USING (s_suppkey)")
def sem_join_left(spark, sf_dir):
    return _supplier_nation(spark, sf_dir, "left").select("s_suppkey", "n_name")


@query(f"SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT s_suppkey FROM ({SUPPLIER_MATCH}))")
def sem_join_semi(spark, sf_dir):
    return _supplier_nation(spark, sf_dir, "semi").select("s_suppkey")


@query(f"SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM ({SUPPLIER_MATCH}))")
def sem_join_anti(spark, sf_dir):
    return _supplier_nation(spark, sf_dir, "anti").select("s_suppkey")


_COS = "list_dot_product({0}::DOUBLE[], {1}::DOUBLE[]) / (sqrt(list_dot_product({0}::DOUBLE[], {0}::DOUBLE[])) * sqrt(list_dot_product({1}::DOUBLE[], {1}::DOUBLE[])))"


@query(f"""SELECT a.vec_id AS query_id, b.vec_id AS vec_id FROM embeddings a CROSS JOIN embeddings b
 WHERE a.vec_id % 100 = 0 AND {_COS.format('a.embedding', 'b.embedding')} >= 0.2 AND {pick("'Same as ' || a.vec_id || ': ' || b.vec_id", 'Yes', 'No')} = 'Yes'""")
def sem_join_prefilter(spark, sf_dir):
    """A search: the stated query set against all rows."""
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    close = semantic.Prefilter("query_embedding", "embedding", 0.2, keep=False)
    found = semantic.sem_join(e, q, "Same as {query_id}: {vec_id}", HashBackend(), prefilter=close)
    return found.select("query_id", "vec_id")


@query(f"""SELECT p_brand, round(avg({pick("'Rate ' || p_name || ' from 0 to 5'", *SCORES)}::DOUBLE), 6) AS score FROM part GROUP BY p_brand""")
def sem_avg(spark, sf_dir):
    return semantic.sem_agg(table(spark, sf_dir, "part"), ["p_brand"], "Rate {text:p_name} from 0 to 5", HashBackend(SCORES), "score", digits=6)


_CHEAP, _ONE, _TWO = "o_orderstatus = 'F'", "Is {text:c_name} loyal?", "Is order {text:o_orderkey} urgent?"


@query(f"""SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'
 AND {pick("'Is ' || c_name || ' loyal?'", 'Yes', 'No')} = 'Yes' AND {pick("'Is order ' || o_orderkey || ' urgent?'", 'Yes', 'No')} = 'Yes'""")
def sem_cascade(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    steps = [semantic.Step(_TWO, cost=2.0), semantic.Step(_ONE), semantic.Step(condition=F.expr(_CHEAP))]
    return semantic.cascade(o.join(c, o["o_custkey"] == c["c_custkey"]), steps, HashBackend()).select("o_orderkey")


class _Plain:
    """The hash backend without its expression: replies come from Python workers."""

    def __init__(self, choices: tuple[str, ...] = YES_NO) -> None:
        self.inner = HashBackend(choices)

    def complete(self, prompts, choices, json_schema=None):
        return self.inner.complete(prompts, choices, json_schema)


@query(f"SELECT o_orderkey, {pick("'Priority ' || o_orderpriority || ', status ' || o_orderstatus", 'Yes', 'No')} AS reply FROM orders")
def sem_dedup(spark, sf_dir):
    return semantic.sem_map(table(spark, sf_dir, "orders"), "Priority {o_orderpriority}, status {o_orderstatus}", "reply", _Plain()).select("o_orderkey", "reply")


@query(f"SELECT c_custkey, n_name FROM {JOINED} WHERE {pick(COUNTRY_SQL, 'Yes', 'No')} = 'Yes'")
def sem_filter_asked(spark, sf_dir):
    return semantic.sem_filter(customers(spark, sf_dir), COUNTRY, _Plain()).select("c_custkey", "n_name")


@query(f"SELECT c_custkey, {pick(COUNTRY_SQL, 'Yes', 'No')} AS first, {pick("'Segment ' || c_mktsegment || ', first ' || " + pick(COUNTRY_SQL, 'Yes', 'No'), 'A', 'B', 'C')} AS second FROM {JOINED}")
def sem_multi_asked(spark, sf_dir):
    one = semantic.sem_map(customers(spark, sf_dir), COUNTRY, "first", _Plain())
    return semantic.sem_map(one, "Segment {c_mktsegment}, first {first}", "second", _Plain(("A", "B", "C"))).select("c_custkey", "first", "second")


@query(f"""SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'
 AND {pick("'Is ' || c_name || ' loyal?'", 'Yes', 'No')} = 'Yes' AND {pick("'Is order ' || o_orderkey || ' urgent?'", 'Yes', 'No')} = 'Yes'""")
def sem_cascade_asked(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    steps = [semantic.Step(_TWO, cost=2.0), semantic.Step(_ONE), semantic.Step(condition=F.expr(_CHEAP))]
    return semantic.cascade(o.join(c, o["o_custkey"] == c["c_custkey"]), steps, _Plain()).select("o_orderkey")


_SEGMENT_MATCH = f"SELECT DISTINCT c_mktsegment, c_nationkey, n_name FROM {JOINED} WHERE {pick("'Is ' || c_mktsegment || ' large in ' || n_name || '?'", 'Yes', 'No')} = 'Yes'"


def _segments_in(spark, sf_dir, how):
    """Left rows that repeat: segments and nations of customers."""
    c, n = table(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey"), table(spark, sf_dir, "nation")
    return semantic.sem_join(c, n, "Is {c_mktsegment} large in {n_name}?", _Plain(), on=F.col("c_nationkey") == F.col("n_nationkey"), how=how)


@query(f"SELECT c.c_mktsegment, c.c_nationkey, m.n_name FROM customer c LEFT JOIN ({_SEGMENT_MATCH}) m USING (c_mktsegment, c_nationkey)")
def sem_join_left_repeated(spark, sf_dir):
    return _segments_in(spark, sf_dir, "left").select("c_mktsegment", "c_nationkey", "n_name")


@query(f"SELECT c.c_mktsegment, c.c_nationkey FROM customer c SEMI JOIN ({_SEGMENT_MATCH}) m USING (c_mktsegment, c_nationkey)")
def sem_join_semi_repeated(spark, sf_dir):
    return _segments_in(spark, sf_dir, "semi").select("c_mktsegment", "c_nationkey")


@query(f"SELECT s_suppkey, r_name FROM supplier, region WHERE {pick(SUPPLIER_REGION_SQL, 'Yes', 'No')} = 'Yes'")
def sem_join_cross_asked(spark, sf_dir):
    return semantic.sem_join(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "region"), SUPPLIER_REGION, _Plain()).select("s_suppkey", "r_name")


@query(f"""SELECT p_brand, round(avg({pick("'Rate ' || p_brand || ', ' || p_size || ' from 0 to 5'", *SCORES)}::DOUBLE), 6) AS score FROM part GROUP BY p_brand""")
def sem_avg_asked(spark, sf_dir):
    return semantic.sem_agg(table(spark, sf_dir, "part"), ["p_brand"], "Rate {p_brand}, {p_size} from 0 to 5", _Plain(SCORES), "score", digits=6)


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 1 THEN 'yes ' || n_regionkey END AS reply,
 CASE n_nationkey % 3 WHEN 0 THEN 'no prompt' WHEN 1 THEN 'ok' ELSE 'failed' END AS status FROM nation""")
def sem_status(spark, sf_dir):
    kind = F.col("n_nationkey") % 3
    asked = table(spark, sf_dir, "nation").withColumn("prompt", F.when(kind == 1, F.concat(F.lit("region "), "n_regionkey")).when(kind == 2, "unknown"))
    said = RecordedBackend({f"region {i}": f"yes {i}" for i in range(5)})
    return semantic.infer(asked, "prompt", "reply", said, status="status").select("n_nationkey", "reply", "status")


@query(f"""SELECT doc_id, {pick("'Lang of ' || coalesce(lang, 'None') || ' ' || doc_id", 'Yes', 'No')} AS answer FROM documents""")
def sem_json_answer(spark, sf_dir):
    asked = semantic.sem_map(table(spark, sf_dir, "documents"), "Lang of {lang} {doc_id}", "reply", HashBackend(), json_schema=benchmarks.ANSWER_SCHEMA)
    return asked.select("doc_id", tx.json_answer(F.col("reply")).alias("answer"))


@query(f"SELECT c_custkey FROM customer WHERE {pick("'Is ' || c_name || ' in ' || c_mktsegment || '?'", 'Yes', 'No')} = 'Yes'")
def sql_llm(spark, sf_dir):
    table(spark, sf_dir, "customer").createOrReplaceTempView("sql_llm_customer")
    semantic.register_llm(spark, _Plain(), "LLM")
    return spark.sql("SELECT c_custkey FROM sql_llm_customer WHERE LLM('Is {text:c_name} in ', '{text:c_mktsegment}?', c_name, c_mktsegment) = 'Yes'")


@query(f"""SELECT n_name, r_name, {pick("'Kind of ' || n_name || '?'", 'Yes', 'No')} AS kind FROM nation, region WHERE {pick("'You get two names. Does ' || n_name || ' lie in ' || r_name || '?'", 'Yes', 'No')} = 'Yes'""")
def sql_logo_join(spark, sf_dir):
    table(spark, sf_dir, "nation").createOrReplaceTempView("logo_nation")
    table(spark, sf_dir, "region").createOrReplaceTempView("logo_region")
    semantic.register_llm(spark, _Plain(), "LLM")
    return spark.sql("""WITH joined AS (SELECT n_name, r_name FROM logo_nation n, logo_region r WHERE LLM('You get two names. ', 'Does {text:n_name} lie in {text:r_name}?', n_name, r_name) = 'Yes')
      SELECT n_name, r_name, LLM('Kind of {text:n_name}?', n_name => n_name) AS kind FROM joined""".replace("n_name => n_name", "n_name"))


# ---- scoring

_REPLY = pick("'Quality of ' || doc_id || '?'", "0", "1")


def judged(spark, sf_dir):
    return semantic.sem_map(table(spark, sf_dir, "labels"), "Quality of {doc_id}?", "predicted", HashBackend(("0", "1")))


@query(f"SELECT doc_id, CASE WHEN {_REPLY} = quality::VARCHAR THEN 1 ELSE 0 END AS is_correct FROM labels")
def score_exact(spark, sf_dir):
    return judged(spark, sf_dir).select("doc_id", scoring.exact(F.col("predicted"), F.col("quality").cast("string")).alias("is_correct"))


@query("SELECT p_partkey, CASE WHEN contains(lower(p_name), lower(trim(string_split(p_type, ' ')[1]))) THEN 1 ELSE 0 END AS is_correct FROM part")
def score_contains(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scoring.contains(F.col("p_name"), F.split("p_type", " ")[0]).alias("is_correct"))


@query("SELECT p_partkey, CASE WHEN len(list_filter(string_split(p_type, ' '), lambda x: lower(p_name) LIKE '%' || lower(trim(x)) || '%')) > 0 THEN 1 ELSE 0 END AS is_correct FROM part")
def score_any(spark, sf_dir):
    reply = F.to_json(F.struct(F.col("p_name").alias("Answer")))
    return table(spark, sf_dir, "part").select("p_partkey", scoring.any_answer(reply, F.split("p_type", " ")).alias("is_correct"))


@query("""SELECT p_partkey, coalesce(list_position(list_transform(string_split(p_name, ' '), lambda x: lower(trim(x))), lower(string_split(p_name, ' ')[-1])), 0)::INT - 1 AS at FROM part""")
def score_index(spark, sf_dir):
    words = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select("p_partkey", tx.answer_index(F.upper(F.element_at(words, -1)), words).alias("at"))


@query(f"SELECT count(*) AS n, sum(ok)::BIGINT AS correct, avg(ok) * 100 AS accuracy FROM (SELECT CASE WHEN {_REPLY} = quality::VARCHAR THEN 1 ELSE 0 END AS ok FROM labels)")
def accuracy(spark, sf_dir):
    return scoring.accuracy(score_exact(spark, sf_dir))


_YES = f"CASE WHEN {_REPLY} = '1' THEN 'yes' ELSE 'no' END"


def image_answers(spark, sf_dir):
    word = lambda c: F.when(c, "Yes").otherwise("No")
    return judged(spark, sf_dir).select(F.concat((F.floor(F.col("doc_id") / 3)).cast("string"), F.lit(","), F.col("doc_id").cast("string")).alias("question_id"), word(F.col("quality") == 1).alias("answer"), word(F.col("predicted") == "1").alias("predicted"))


@query(f"""WITH r AS (SELECT doc_id // 3 AS image, CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS a, {_YES} AS p FROM labels),
i AS (SELECT image, bool_and(a = p) AS all_right FROM r GROUP BY image),
t AS (SELECT count(DISTINCT image) AS images, count(*) AS questions, count(*) FILTER (a = p) AS correct, (SELECT count(*) FROM i WHERE all_right) AS images_correct,
 count(*) FILTER (a = 'yes' AND p = 'yes') AS tp, count(*) FILTER (a = 'no' AND p = 'no') AS tn, count(*) FILTER (a = 'no' AND p = 'yes') AS fp, count(*) FILTER (a = 'yes' AND p = 'no') AS fn FROM r)
SELECT *, correct / questions * 100 AS accuracy, images_correct / images * 100 AS accuracy_plus, (correct / questions + images_correct / images) * 100 AS score, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM t""")
def mme_score(spark, sf_dir):
    return scoring.mme(image_answers(spark, sf_dir))


@query(f"SELECT CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS answer, {_YES} AS predicted, count(*) AS count FROM labels GROUP BY 1, 2")
def confusion(spark, sf_dir):
    return scoring.confusion(image_answers(spark, sf_dir), "answer", "predicted")


@query(f"""WITH r AS (SELECT quality, CASE WHEN {_REPLY} = quality::VARCHAR THEN 1 ELSE 0 END AS ok FROM labels)
SELECT quality::VARCHAR AS run, count(*) AS n, sum(ok)::BIGINT AS correct, sum(ok) * 100 / count(*) AS accuracy FROM r GROUP BY quality
UNION ALL SELECT 'total', count(*), sum(ok)::BIGINT, sum(ok) * 100 / count(*) FROM r""")
def accuracy_rollup(spark, sf_dir):
    rows = judged(spark, sf_dir).select(F.col("quality").cast("string").alias("run"), scoring.exact(F.col("predicted"), F.col("quality").cast("string")).alias("is_correct"))
    return scoring.accuracy_with_total(rows, "run")


@query("SELECT event_type, 'value' AS metric, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(min(value), 6) AS min, round(max(value), 6) AS max, round(sum(value), 3) AS sum FROM events GROUP BY event_type")
def timing_summary(spark, sf_dir):
    s = scoring.timing_summary(table(spark, sf_dir, "events"), ["value"], ["event_type"])
    return s.select("event_type", "metric", *[F.round(c, 3 if c == "sum" else 6).alias(c) for c in ("mean", "median", "min", "max", "sum")])


@query("SELECT event_type, round(sum(value), 3) AS score FROM events GROUP BY event_type ORDER BY score DESC, event_type LIMIT 1")
def best_run(spark, sf_dir):
    return scoring.best_run(table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.sum("value"), 3).alias("score")), "event_type", "score")


@query("""SELECT event_type, avg(CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END) * 100 AS accuracy, round(sum(value), 3) AS total_time, round(sum(value / 2), 3) AS part_time, 50.0::DOUBLE AS part_share FROM events GROUP BY event_type""")
def keep_ratio_sweep(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.when(F.col("user_id") % 2 == 0, 1).otherwise(0).alias("ok"), "value", (F.col("value") / 2).alias("prune"))
    return scoring.sweep(rows, "event_type", "ok", "value", "prune").select("event_type", "accuracy", F.round("total_time", 3).alias("total_time"), F.round("part_time", 3).alias("part_time"), F.round("part_share", 6).alias("part_share"))


@query("SELECT n_chars::DOUBLE AS value, row_number() OVER (ORDER BY n_chars) / count(*) OVER () AS share FROM documents WHERE n_chars IS NOT NULL")
def cdf(spark, sf_dir):
    return scoring.cdf(table(spark, sf_dir, "documents"), "n_chars")


@query("SELECT avg(CASE WHEN l_extendedprice > fence THEN 1.0 ELSE 0.0 END)::DOUBLE AS ratio FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.75) + 1.5 * (quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)) AS fence FROM lineitem)")
def iqr_ratio(spark, sf_dir):
    return scoring.outlier_share(table(spark, sf_dir, "lineitem"), "l_extendedprice")


@query("SELECT source, 'n_chars' AS metric, min(n_chars)::DOUBLE AS min, max(n_chars)::DOUBLE AS max, round(avg(n_chars), 6) AS mean, median(n_chars)::DOUBLE AS median FROM documents GROUP BY source")
def dataset_stats(spark, sf_dir):
    s = scoring.describe(table(spark, sf_dir, "documents"), ["n_chars"], ["source"])
    return s.withColumn("mean", F.round("mean", 6))


# ---- grouping and tokens


@query("""WITH d AS (SELECT p_partkey, list_transform(range(0, 16), lambda i: ('0x' || substr(md5(p_name), 2 * i + 1, 2))::INT - 127.5) AS v FROM part)
SELECT p_partkey, list_transform(v, lambda x: round(((x / sqrt(list_sum(list_transform(v, lambda y: y * y))))::FLOAT)::DOUBLE, 5)) AS vec FROM d""")
def embed_text(spark, sf_dir):
    e = embedding.embed(table(spark, sf_dir, "part"), "p_name", embedding.HashEncoder())
    return e.select("p_partkey", F.transform(F.col("p_name_embedding").cast("array<double>"), lambda x: F.round(x, 5)).alias("vec"))


@query("SELECT l_partkey, count(*) AS redundancy FROM lineitem GROUP BY l_partkey")
def redundancy(spark, sf_dir):
    return grouping.redundancy(table(spark, sf_dir, "lineitem"), "l_partkey")


@query("SELECT count(*)::BIGINT AS rows, count(DISTINCT l_partkey) AS keys, count(*) / count(DISTINCT l_partkey) AS average FROM lineitem")
def redundancy_summary(spark, sf_dir):
    return grouping.redundancy_summary(table(spark, sf_dir, "lineitem"), "l_partkey")


@query("""SELECT c_nationkey, 'Extract the image''s key information based on the below questions: ' || string_agg('"' || c_name || '"', ', ' ORDER BY c_custkey) AS guidance, count(*) AS questions FROM customer GROUP BY c_nationkey""")
def group_guidance(spark, sf_dir):
    return grouping.guidance(table(spark, sf_dir, "customer"), "c_nationkey", "c_name", "c_custkey")


@query("SELECT l_partkey, count(*) AS redundancy FROM lineitem GROUP BY l_partkey ORDER BY redundancy DESC, l_partkey LIMIT 10")
def top_images(spark, sf_dir):
    return grouping.top_keys(table(spark, sf_dir, "lineitem"), "l_partkey")


@query("SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand)::INT AS image_id FROM part")
def dense_rank_ids(spark, sf_dir):
    return grouping.key_ids(table(spark, sf_dir, "part"), "p_brand", "image_id", dense=True).select("p_partkey", "image_id")


@query("SELECT p_partkey, length(p_brand)::INT * 2 AS encoded, 'ok' AS status FROM part")
def encode_once(spark, sf_dir):
    return grouping.encode_once(table(spark, sf_dir, "part"), "p_brand", lambda b: len(b) * 2, "p_brand", "int").select("p_partkey", "encoded", "status")


@query("SELECT c_custkey, coalesce(s_acctbal, 0.0) AS s_acctbal FROM customer LEFT JOIN (SELECT s_suppkey, s_acctbal FROM supplier) ON c_custkey = s_suppkey")
def embedding_lookup(spark, sf_dir):
    cache = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), "s_acctbal")
    return grouping.lookup(table(spark, sf_dir, "customer"), cache, "c_custkey", "s_acctbal", F.lit(0.0)).select("c_custkey", "s_acctbal")


@query("""SELECT item_id, 576::BIGINT AS image_tokens, len(regexp_extract_all(text, '[\\pL\\pM\\pN_]+|[^\\pL\\pM\\pN_\\s]'))::BIGINT AS text_tokens, 576 + len(regexp_extract_all(text, '[\\pL\\pM\\pN_]+|[^\\pL\\pM\\pN_\\s]'))::BIGINT AS total_tokens, (336 * 336)::BIGINT AS total_pixels, 336::BIGINT AS image_width, 336::BIGINT AS image_height FROM benchmark""")
def token_stats(spark, sf_dir):
    return tokens.token_counts(table(spark, sf_dir, "benchmark"), "item_id", F.col("text"), F.lit(336), F.lit(336))


#: A row per shard and request, with the cache after it: entries held and by which requests,
#: free ones from the oldest on, and requests not yet freed.
_CACHE_SQL = """WITH RECURSIVE e AS (SELECT user_id % 16 AS shard, event_id, user_id AS k, (user_id % 7 + 1) * 64 AS t, row_number() OVER (PARTITION BY user_id % 16 ORDER BY event_id) AS seq FROM events),
w AS (
  SELECT DISTINCT shard, 0::BIGINT AS seq, 0::BIGINT AS event_id, '' AS outcome, 0::BIGINT AS used,
         []::STRUCT(k BIGINT, size BIGINT, users BIGINT[])[] AS held, []::STRUCT(k BIGINT, size BIGINT)[] AS frees, []::STRUCT(k BIGINT, seq BIGINT)[] AS recent FROM e
  UNION ALL
  SELECT shard, seq, event_id, outcome, used, left_held, CASE WHEN idle AND NOT list_contains(list_transform(frees, lambda f: f.k), gone.k) THEN list_append(frees, {'k': gone.k, 'size': list_filter(left_held, lambda h: h.k = gone.k)[1].size}) ELSE frees END, recent
  FROM (
    SELECT *, coalesce(len(list_filter(left_held, lambda h: h.k = gone.k AND len(h.users) = 0)) > 0, false) AS idle
    FROM (
      SELECT shard, seq, event_id, outcome, used, frees, gone, CASE WHEN gone IS NULL THEN recent ELSE recent[2:] END AS recent,
             list_transform(held, lambda h: {'k': h.k, 'size': h.size, 'users': CASE WHEN h.k = gone.k THEN list_filter(h.users, lambda u: u <> gone.seq) ELSE h.users END}) AS left_held
      FROM (
        SELECT *, CASE WHEN len(recent) > 4 THEN recent[1] END AS gone
        FROM (
          SELECT shard, seq, event_id, outcome,
                 CASE outcome WHEN 'miss' THEN used + t - coalesce(list_sum(list_transform(frees[1:evict], lambda f: f.size)), 0)::BIGINT ELSE used END AS used,
                 CASE outcome WHEN 'hit' THEN list_transform(held, lambda h: {'k': h.k, 'size': h.size, 'users': CASE WHEN h.k = k THEN list_append(h.users, seq) ELSE h.users END})
                              WHEN 'miss' THEN list_append(list_filter(held, lambda h: NOT list_contains(list_transform(frees[1:evict], lambda f: f.k), h.k)), {'k': k, 'size': t, 'users': [seq]}) ELSE held END AS held,
                 CASE outcome WHEN 'hit' THEN list_filter(frees, lambda f: f.k <> k) WHEN 'miss' THEN frees[evict + 1:] ELSE frees END AS frees,
                 CASE WHEN outcome = 'rejected' THEN recent ELSE list_append(recent, {'k': k, 'seq': seq}) END AS recent, t
          FROM (
            SELECT *, len(list_filter(range(1, len(frees) + 1), lambda i: coalesce(list_sum(list_transform(frees[1:i - 1], lambda f: f.size)), 0) < t - (4096 - used))) AS evict,
                   CASE WHEN list_contains(list_transform(held, lambda h: h.k), k) THEN 'hit' WHEN t > 4096 - used + coalesce(list_sum(list_transform(frees, lambda f: f.size)), 0) THEN 'rejected' ELSE 'miss' END AS outcome
            FROM (SELECT w.shard, e.seq, e.event_id, e.k, e.t, w.used, w.held, w.frees, w.recent FROM w JOIN e ON w.shard = e.shard AND e.seq = w.seq + 1)
          )
        )
      )
    )
  )
)
SELECT shard, event_id, outcome, used FROM w WHERE seq > 0"""


@query(_CACHE_SQL)
def encoder_cache_sim(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("tokens", (F.col("user_id") % 7 + 1) * 64).withColumn("shard", F.pmod(F.col("user_id"), F.lit(16)))
    return cachesim.simulate(events, "shard", "event_id", "user_id", "tokens", capacity=4096, window=4)


_TILES = ((336, 672), (672, 336), (672, 672), (1008, 336), (336, 1008))


@query(f"""WITH i AS (SELECT p_partkey, (p_size * 53 + 40)::BIGINT AS w, (p_partkey % 1300 + 30)::BIGINT AS h FROM part),
c AS (SELECT *, unnest([{", ".join(f"{{'place': {n}, 'tw': {w}, 'th': {h}}}" for n, (w, h) in enumerate(_TILES))}], recursive := true) FROM i),
f AS (SELECT *, least((floor(w * least(tw / w, th / h)) * floor(h * least(tw / w, th / h)))::BIGINT, w * h) AS kept FROM c),
b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY kept DESC, tw * th - kept, place) = 1),
m AS (SELECT *, tw // 336 AS columns, th // 336 AS rows, tw // 336 * 24 AS c, th // 336 * 24 AS r FROM b),
u AS (SELECT *, CASE WHEN w * r > h * c THEN c ELSE c - 2 * floor((c - floor(w * r / h)) / 2) END AS uc, CASE WHEN w * r > h * c THEN r - 2 * floor((r - floor(h * c / w)) / 2) ELSE r END AS ur FROM m)
SELECT p_partkey, columns::INT AS columns, rows::INT AS rows, (576 + (uc + 1) * ur)::BIGINT AS tokens FROM u""")
def anyres_tokens(spark, sf_dir):
    width, height = (F.col("p_size") * 53 + 40).cast("long"), F.col("p_partkey") % 1300 + 30
    shape = anyres.grid_shape(width, height, _TILES, 336)
    return table(spark, sf_dir, "part").select("p_partkey", shape["columns"].alias("columns"), shape["rows"].alias("rows"), anyres.token_count(width, height, _TILES, 336, 14).alias("tokens"))


# ---- layout

_PARTS = ("p_brand", "p_type", "p_size")


@query("""WITH c AS (SELECT 0 AS place, 'p_brand' AS "column", p_brand AS v FROM part UNION ALL SELECT 1, 'p_type', p_type FROM part UNION ALL SELECT 2, 'p_size', p_size::VARCHAR FROM part)
SELECT place, "column", count(*) AS n_rows, count(DISTINCT v) AS n_distinct, round(avg(length(v) * length(v)), 6) AS mean_len2,
 round(avg(length(v) * length(v)) * (count(*) / count(DISTINCT v) - 1), 4) AS score, round(avg(length(v)) / count(DISTINCT v), 6) AS len_per_value FROM c GROUP BY place, "column" """)
def col_stats(spark, sf_dir):
    s = layout.column_stats(table(spark, sf_dir, "part"), *_PARTS)
    return s.withColumn("mean_len2", F.round("mean_len2", 6)).withColumn("score", F.round("score", 4)).withColumn("len_per_value", F.round("len_per_value", 6))


@query("""WITH c AS (SELECT 0 AS place, 'p_brand' AS name, p_brand AS v FROM part UNION ALL SELECT 1, 'p_type', p_type FROM part UNION ALL SELECT 2, 'p_size', p_size::VARCHAR FROM part),
s AS (SELECT place, name, avg(length(v) * length(v)) * (count(*) / count(DISTINCT v) - 1) AS score FROM c GROUP BY place, name)
SELECT (row_number() OVER (ORDER BY score DESC, place) - 1)::INT AS rank, name FROM s""")
def col_order(spark, sf_dir):
    order = layout.column_order(table(spark, sf_dir, "part"), *_PARTS)
    return spark.createDataFrame(list(enumerate(order)), "rank int, name string")


@query("SELECT value, count(*) AS cells FROM (SELECT p_brand AS value FROM part UNION ALL SELECT p_type FROM part UNION ALL SELECT p_size::VARCHAR FROM part) GROUP BY value")
def value_groups(spark, sf_dir):
    return layout.value_groups(table(spark, sf_dir, "part"), *_PARTS)


@query("SELECT 'n_nationkey' AS a, 'n_name' AS b, 1.0::DOUBLE AS forward, 1.0::DOUBLE AS backward WHERE (SELECT count(DISTINCT n_name) = count(DISTINCT n_nationkey) FROM nation) UNION ALL SELECT 'n_regionkey', 'r_name', 1.0, 1.0")
def fd_pairs(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return layout.dependencies(n.join(r, n["n_regionkey"] == r["r_regionkey"]), "n_nationkey", "n_name", "n_regionkey", "r_name")


@query("SELECT r_regionkey::VARCHAR || ' ' || r_name AS r_regionkey_r_name FROM region")
def merge_columns(spark, sf_dir):
    return layout.merge_columns(table(spark, sf_dir, "region"), [["r_regionkey", "r_name"]])


@query("SELECT p_type, p_brand, p_size FROM part")
def fixed_reorder(spark, sf_dir):
    return layout.fixed_reorder(table(spark, sf_dir, "part").select(*_PARTS), partitions=8)


@query()
def ggr_layout(spark, sf_dir):
    return layout.greedy_layout(table(spark, sf_dir, "part"), "p_partkey", *_PARTS, "p_name", early_stop=100)


@query("""WITH p AS (SELECT [p_brand] AS k FROM part UNION ALL SELECT [p_brand, p_type] FROM part UNION ALL SELECT [p_brand, p_type, p_size::VARCHAR] FROM part),
g AS (SELECT k, count(*) AS c, length(k[-1])::DOUBLE ** 4 AS w FROM p GROUP BY k)
SELECT sum(c)::BIGINT AS cells, sum(c - 1)::BIGINT AS hits, sum(c - 1) * 100 / sum(c) AS hit_rate, sum((c - 1) * w) AS weighted_hits, sum((c - 1) * w) * 100 / sum(c * w) AS weighted_rate FROM g""")
def prefix_cell_hits(spark, sf_dir):
    return layout.cell_hits(table(spark, sf_dir, "part"), *_PARTS)


_CHAR_SQL = """WITH p AS (SELECT p_brand || p_type || p_size::VARCHAR AS p FROM part),
d AS (SELECT count(DISTINCT (p[1:k])) AS prefixes FROM (SELECT p, unnest(range(1, length(p) + 1)) AS k FROM p)),
t AS (SELECT (SELECT sum(length(p)) FROM p)::BIGINT AS chars, (SELECT sum(length(p)) FROM p)::BIGINT - (SELECT prefixes FROM d) AS hits)"""


def _part_prompt() -> Column:
    return F.concat(*[F.col(c).cast("string") for c in _PARTS])


@query(_CHAR_SQL + " SELECT chars, hits, hits * 100 / chars AS hit_rate FROM t")
def prefix_char_hits(spark, sf_dir):
    return layout.char_hits(table(spark, sf_dir, "part"), _part_prompt())


@query(_CHAR_SQL + " SELECT chars, hits, round(((chars - hits) * 2.5 + hits * 1.25) / 5e6, 9) AS cost, round(chars * 2.5 / 5e6, 9) AS cost_uncached FROM t")
def prefix_cost(spark, sf_dir):
    return layout.prompt_cost(layout.char_hits(table(spark, sf_dir, "part"), _part_prompt())).select("chars", "hits", F.round("cost", 9).alias("cost"), F.round("cost_uncached", 9).alias("cost_uncached"))


@query("""WITH l AS (SELECT p_brand, p_type, lag(p_type) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS prev FROM part),
k AS (SELECT p_brand, p_type, coalesce(list_max(list_filter(range(0, length(p_type) + 1), lambda n: n <= length(prev) AND p_type[1:n] = prev[1:n])), 0) AS shared FROM l)
SELECT p_brand, sum(length(p_type))::BIGINT AS chars, sum(shared)::BIGINT AS hits FROM k GROUP BY p_brand""")
def adjacent_prefix_hits(spark, sf_dir):
    return layout.adjacent_hits(table(spark, sf_dir, "part"), "p_type", "p_partkey", ["p_brand"])


# ---- vectors


def _queries(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


@query(f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round({_COS.format('q.embedding', 'e.embedding')}, 6) AS similarity FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 100 = 0)
SELECT query_id, vec_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id)::INT AS rank FROM s QUALIFY rank <= 5""")
def vec_topk(spark, sf_dir):
    return vectors.nearest(_queries(spark, sf_dir), table(spark, sf_dir, "embeddings"), "query_id", "vec_id", "query_vec", "embedding", 5)


@query(f"""WITH raw AS (SELECT e.vec_id, avg(-({_COS.format('q.embedding', 'e.embedding')})) AS r FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 100 = 0 GROUP BY e.vec_id)
SELECT vec_id, round((r - (SELECT min(r) FROM raw)) / ((SELECT max(r) FROM raw) - (SELECT min(r) FROM raw) + 1e-6), 6) AS relevance FROM raw""")
def vec_relevance(spark, sf_dir):
    return vectors.relevance(table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir), "vec_id", "embedding", "query_vec").select("vec_id", F.round("relevance", 6).alias("relevance"))


@query("""WITH s AS (SELECT e.label, e.vec_id, round(avg(-list_sum(list_transform(list_zip(e.embedding::DOUBLE[], t.embedding::DOUBLE[]), lambda z: (z[1] - z[2]) ** 2))), 9) AS score FROM embeddings e JOIN embeddings t ON e.label = t.label AND t.vec_id % 10 = 0 GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS r, count(*) OVER (PARTITION BY label) AS c FROM s)
SELECT label, vec_id FROM n WHERE r <= floor(0.8 * c)""")
def trim_stage1(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    far = vectors.mean_squared_distance(e, e.filter("vec_id % 10 = 0"), "label", "vec_id", "embedding")
    scored = far.select("label", "vec_id", F.round(-F.col("distance"), 9).alias("score"))
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("r", place).withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("label"))).filter("r <= floor(0.8 * c)").select("label", "vec_id")


_UNIT = "list_transform({0}, lambda v: list_transform(v, lambda y: y / sqrt(list_dot_product(v, v))))"
#: Per label: ids, number and vectors of the candidates, similarities to each other (s), mean
#: similarity to the text vectors (r), and how many are to be kept (k).
_GROUPS_SQL = f"""WITH RECURSIVE g AS (
  SELECT label, list(vec_id ORDER BY vec_id) FILTER (vec_id % 10 <> 0) AS ids, list(embedding::DOUBLE[] ORDER BY vec_id) FILTER (vec_id % 10 <> 0) AS x,
         coalesce(list(embedding::DOUBLE[] ORDER BY vec_id) FILTER (vec_id % 10 = 0), []) AS t FROM embeddings GROUP BY label),
u AS (SELECT label, ids, len(ids) AS n, x, t, {_UNIT.format("x")} AS ux, {_UNIT.format("t")} AS ut FROM g WHERE ids IS NOT NULL),
m AS (SELECT label, ids, n, floor(0.222 * n)::INT AS k, x, t, list_transform(ux, lambda a: list_transform(ux, lambda b: list_dot_product(a, b))) AS s,
        list_transform(ux, lambda a: coalesce(list_avg(list_transform(ut, lambda b: list_dot_product(a, b))), 0)) AS r FROM u)"""
_CHOSEN_SQL = "SELECT label, ids[c] AS vec_id, (row_number() OVER (PARTITION BY label ORDER BY c) - 1)::INT AS rank FROM (SELECT label, ids, unnest(chosen) AS c FROM walk WHERE len(chosen) = k)"
_BEST = "list_position({0}, list_max({0}))"


def _greedy_sql(first: str, score: str, table: str = "m", extra: str = "") -> str:
    """SQL for a greedy choice: ``first`` are the scores of the first step, ``score`` that of
    candidate i given the list ``chosen``. ``table`` has the columns of m."""
    return f"""{_GROUPS_SQL}{extra},
walk AS (
  SELECT label, ids, n, k, s, r, [{_BEST.format("first")}] AS chosen FROM (SELECT *, {first} AS first FROM {table}) WHERE k > 0
  UNION ALL
  SELECT label, ids, n, k, s, r, list_append(chosen, {_BEST.format("scores")}) AS chosen
  FROM (SELECT *, list_transform(range(1, n + 1), lambda i: CASE WHEN list_contains(chosen, i) THEN -1e300 ELSE {score} END) AS scores FROM walk WHERE len(chosen) < k)
)
{_CHOSEN_SQL}"""


_SIMS = "list_transform(chosen, lambda c: s[c][i])"
_FAR = f"1 - list_max({_SIMS})"
_SIGMOID = "1 / (1 + exp(-2 * {0}))"
_SPREAD = ("list_transform(s, lambda y: -list_avg(y))", f"-list_sum({_SIMS}) / len(chosen)")


def _dpp_sql(kernel: str, quality: str = "r") -> str:
    """SQL for the greedy set of a determinantal point process, ``kernel`` in i, j and w, the
    list of qualities: what is left of the diagonal and the factor's rows go along."""
    return f"""{_GROUPS_SQL},
q AS (SELECT *, {quality} AS w FROM m),
l AS (SELECT label, ids, n, k, list_transform(range(1, n + 1), lambda i: list_transform(range(1, n + 1), lambda j: {kernel})) AS kernel FROM q),
walk AS (
  SELECT label, ids, n, k, kernel, list_transform(range(1, n + 1), lambda i: kernel[i][i]) AS rest, []::DOUBLE[][] AS factor, []::BIGINT[] AS chosen FROM l WHERE k > 0
  UNION ALL
  SELECT label, ids, n, k, kernel, list_transform(range(1, n + 1), lambda i: CASE WHEN i = j OR list_contains(chosen, i) THEN -1e300 ELSE rest[i] - fresh[i] * fresh[i] END) AS rest,
         list_append(factor, fresh) AS factor, list_append(chosen, j) AS chosen
  FROM (SELECT *, list_transform(range(1, n + 1), lambda i: (kernel[j][i] - coalesce(list_sum(list_transform(factor, lambda f: f[j] * f[i])), 0)) / sqrt(greatest(rest[j], 1e-12))) AS fresh
        FROM (SELECT *, {_BEST.format("rest")} AS j FROM walk WHERE len(chosen) < k))
)
{_CHOSEN_SQL}"""


_TRIM_EXTRA = """,
far AS (SELECT *, list_transform(x, lambda a: coalesce(list_avg(list_transform(t, lambda b: list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) ** 2)))), -1)) AS d FROM m),
near AS (SELECT *, list_sort(list_transform(list_sort(list_transform(range(1, n + 1), lambda i: {'d': d[i], 'i': i}))[1:floor(0.8 * n)::INT], lambda z: z.i)) AS kept FROM far),
f AS (SELECT label, list_transform(kept, lambda i: ids[i]) AS ids, len(kept) AS n, least(k, len(kept)) AS k, list_transform(kept, lambda i: list_transform(kept, lambda j: s[i][j])) AS s, r FROM near)"""
_VIS_SQL = f"""{_GROUPS_SQL},
o AS (SELECT *, list_transform(list_sort(list_transform(range(1, n + 1), lambda i: {{'r': r[i], 'i': i}}))[1:floor(0.6 * k)::INT], lambda z: z.i) AS top FROM m),
walk AS (
  SELECT label, ids, n, k, s, top, []::BIGINT[] AS others, top AS chosen FROM o WHERE k > 0
  UNION ALL
  SELECT label, ids, n, k, s, top, list_append(others, j) AS others, list_append(chosen, j) AS chosen
  FROM (SELECT *, {_BEST.format("scores")} AS j FROM (SELECT *, list_transform(range(1, n + 1), lambda i: CASE WHEN list_contains(chosen, i) THEN -1e300 ELSE 1 - 0.8 * coalesce(list_sum(list_transform(others, lambda c: s[c][i])), 0) END) AS scores FROM walk WHERE len(chosen) < k))
)
{_CHOSEN_SQL}"""
_SCALED = "list_transform(r, lambda y: (-y - list_min(list_transform(r, lambda z: -z)) + 1e-6) / (list_max(list_transform(r, lambda z: -z)) - list_min(list_transform(r, lambda z: -z)) + 1e-6))"
#: SQL of each selection kernel.
KERNEL_SQL = {
    "cd": _dpp_sql("w[i] * s[i][j] * w[j]", _SCALED),
    "trim": _greedy_sql(*_SPREAD, table="f", extra=_TRIM_EXTRA),
    "spread": _greedy_sql(*_SPREAD),
    "text_div": _greedy_sql("r", f"0.6 * -(list_sum({_SIMS}) / len(chosen)) + 0.4 * r[i]"),
    "dpp": _dpp_sql("s[i][j] * w[i] * w[j] + CASE WHEN i = j THEN 1e-6 ELSE 0 END", "list_transform(r, lambda y: sqrt(greatest(y, 0) + 0.1))"),
    "fps": _greedy_sql(f"list_transform(r, lambda y: {_SIGMOID.format('y')})", f"({_FAR}) * ({_SIGMOID.format('r[i]')})"),
    "div": _greedy_sql("list_transform(range(1, n + 1), lambda i: 1 - coalesce(list_max(list_transform(list_filter(range(1, n + 1), lambda j: j <> i), lambda j: s[i][j])), 0))", _FAR),
    "score_minus": _greedy_sql("list_transform(r, lambda y: 1)", f"1 - 0.8 * list_sum({_SIMS})"),
    "score_minus_text": _greedy_sql("r", f"r[i] - 0.8 * list_sum({_SIMS})"),
    "min_max": _greedy_sql("list_transform(r, lambda y: 1)", f"-list_max({_SIMS})"),
    "vis": _VIS_SQL,
}


def _select(kernel: str) -> None:
    def run(spark, sf_dir):
        marked = table(spark, sf_dir, "embeddings").withColumn("is_text", F.col("vec_id") % 10 == 0)
        return vectors.select_vectors(marked, "label", "vec_id", "embedding", kernel, 0.222, "is_text")

    run.__name__ = f"select_{kernel}"
    QUERIES[run.__name__], ORACLES[run.__name__] = run, KERNEL_SQL[kernel]


for _name in vectors.KERNELS:
    _select(_name)


@query(f"""{_GROUPS_SQL},
o AS (SELECT *, len(list_filter(r, lambda y: y > hi + 1.5 * (hi - lo))) / n AS share FROM (SELECT *, list_aggregate(r, 'quantile_cont', 0.25) AS lo, list_aggregate(r, 'quantile_cont', 0.75) AS hi FROM m WHERE k > 0)),
walk AS (SELECT label, ids, greatest(1, floor(n * greatest(share, 1 / n))::INT) AS k, list_transform(list_sort(list_transform(range(1, n + 1), lambda i: {{'r': -r[i], 'i': i}}))[1:greatest(1, floor(n * greatest(share, 1 / n))::INT)], lambda z: z.i) AS chosen FROM o)
{_CHOSEN_SQL}""")
def prumerge(spark, sf_dir):
    merge = lambda x, texts, k: vectors.merge_tokens(x, vectors.mean_cosine(x, texts), 8)[0]
    marked = table(spark, sf_dir, "embeddings").withColumn("is_text", F.col("vec_id") % 10 == 0)
    return vectors.select_vectors(marked, "label", "vec_id", "embedding", merge, 0.222, "is_text")


# ---- text, set operations, context


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\\n\\r]+', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM documents")
def text_clean(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.fold_space(F.col("text")).alias("text"))


@query("SELECT 'r_regionkey: ' || r_regionkey AS r_regionkey, 'r_name: ' || r_name AS r_name FROM region")
def prepend_name(spark, sf_dir):
    return tx.prepend_name(table(spark, sf_dir, "region"))


@query("SELECT r_regionkey::VARCHAR AS r_regionkey, r_name FROM region")
def unprepend_name(spark, sf_dir):
    return tx.unprepend_name(tx.prepend_name(table(spark, sf_dir, "region")))


@query("SELECT p_partkey, (length(p_name) ** 2)::BIGINT AS name_weight, (length(p_size::VARCHAR) ** 2)::BIGINT AS size_weight FROM part")
def value_weights(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", tx.value_weight(p, "p_name").alias("name_weight"), tx.value_weight(p, "p_size").alias("size_weight"))


@query("SELECT p_partkey, p_brand || ' ' || p_type AS combined, substr(p_name, 1, 77) AS short FROM part")
def combine_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.combine(F.col("p_brand"), F.lit(""), F.lit(None).cast("string"), F.col("p_type")).alias("combined"), tx.for_embedder(F.col("p_name")).alias("short"))


@query("SELECT p_partkey, string_split(p_name, ' ') AS options FROM part")
def option_lists(spark, sf_dir):
    commas = F.when(F.col("p_partkey") % 2 == 0, F.array_join(F.split("p_name", " "), " , ")).otherwise(F.concat(F.lit("['"), F.array_join(F.split("p_name", " "), "', '"), F.lit("']")))
    return table(spark, sf_dir, "part").select("p_partkey", tx.options(commas).alias("options"))


@query("SELECT s_name AS name FROM supplier UNION ALL SELECT c_name FROM customer")
def union_all(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name")).union(table(spark, sf_dir, "customer").select("c_name"))


@query("SELECT o_orderkey, least(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / floor((SELECT count(*) FROM orders) / 7)), 6)::INT AS part FROM orders")
def ordered_split(spark, sf_dir):
    return io.ordered_split(table(spark, sf_dir, "orders"), ["o_orderkey"], 7).select("o_orderkey", "part")


@query("SELECT r_regionkey, r_name FROM region")
def clean_table(spark, sf_dir):
    return io.clean(table(spark, sf_dir, "region").withColumn("Unnamed: 0", F.lit(1)))


@query("SELECT n_name, n_regionkey FROM nation")
def shuffle_rows(spark, sf_dir):
    return io.shuffled(table(spark, sf_dir, "nation").select("n_name", "n_regionkey"), "n_name")


@query("""WITH c AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) || '--- Document Separator ---' || chr(10) || chr(10) ORDER BY turn, text) FILTER (role = 'user' AND text <> '') AS docs, list(text ORDER BY turn, text) FILTER (role = 'assistant') AS paths FROM conversations GROUP BY conv_id)
SELECT conv_id AS qid, 'What is asked in ' || conv_id || '?' AS question, coalesce(docs, 'No context documents available.') AS all_text_docs, coalesce('{"lang":"' || lang || '"}', 'No table data available.') AS table_data, coalesce(paths, []) AS image_paths FROM c LEFT JOIN documents ON doc_id = conv_id""")
def explode_join_context(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").filter("text <> '' or role <> 'user'").withColumn("id", F.concat_ws("/", "conv_id", "turn", F.md5("text")))
    refs = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text", "id")))), lambda s: s["id"])
    everyone = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    asked = everyone.join(turns.groupBy("conv_id").agg(refs("user").alias("text_doc_ids"), refs("assistant").alias("image_doc_ids")), "conv_id", "left")
    questions = asked.select(F.col("conv_id").alias("qid"), F.concat(F.lit("What is asked in "), F.col("conv_id"), F.lit("?")).alias("question"), "text_doc_ids", "image_doc_ids", F.col("conv_id").alias("table_id"))
    texts = turns.filter("role = 'user'").select("id", "text").dropDuplicates(["id"])
    images = turns.filter("role = 'assistant'").select("id", F.col("text").alias("path")).dropDuplicates(["id"])
    tables = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.to_json(F.struct("lang")).alias("table_json"))
    return context.assemble(questions, texts, images, tables)


# ---- files


@query("SELECT o_orderkey, o_orderpriority || ' \", ' || o_orderstatus AS note, o_totalprice FROM orders")
def csv_files(spark, sf_dir):
    path = temporary_path(spark, "csv")
    io.write_csv(table(spark, sf_dir, "orders").select("o_orderkey", F.concat("o_orderpriority", F.lit(' ", '), "o_orderstatus").alias("note"), "o_totalprice"), path, sep=";")
    return io.read_csv(spark, path, "o_orderkey long, note string, o_totalprice double", sep=";")


@query("SELECT r_regionkey, r_name FROM region")
def csv_inferred(spark, sf_dir):
    path = temporary_path(spark, "csv")
    io.write_csv(table(spark, sf_dir, "region"), path, single_file=True)
    return io.read_csv(spark, path)


@query("SELECT doc_id, text, lang FROM documents")
def json_lines(spark, sf_dir):
    path = temporary_path(spark, "json")
    io.write_json(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), path)
    return io.read_json_lines(spark, path, "doc_id long, text string, lang string")


@query("SELECT n_nationkey, n_name FROM nation")
def json_array(spark, sf_dir):
    path = temporary_path(spark, "array")
    rows = table(spark, sf_dir, "nation").agg(F.to_json(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("value"))  # 25 rows
    rows.write.text(path)
    return io.read_json_array(spark, path, "n_nationkey int, n_name string")


@query("SELECT p_brand, count(*) AS parts FROM part GROUP BY p_brand")
def parquet_by_column(spark, sf_dir):
    path = temporary_path(spark, "parquet")
    io.write_parquet(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), path, ["p_brand"])
    return io.read_parquet(spark, path).groupBy("p_brand").agg(F.count(F.lit(1)).alias("parts"))


@query("SELECT r_regionkey, r_name AS said FROM region WHERE r_regionkey < 3 UNION ALL SELECT r_regionkey, NULL FROM region WHERE r_regionkey >= 3")
def file_bytes(spark, sf_dir):
    """Files of one name in a folder for each row; some rows name none."""
    path, regions = temporary_path(spark, "files"), table(spark, sf_dir, "region")
    regions.filter("r_regionkey < 3").repartition(1).select(F.col("r_regionkey").alias("of"), "r_name").write.partitionBy("of").text(path)
    files = io.read_files(spark, f"{path}/*", "*.txt").withColumn("path", F.concat(F.lit("/in/"), F.element_at(F.split("path", "/"), -2), F.lit("/x.txt")))
    name = F.when(F.col("r_regionkey") < 3, "x.txt").otherwise("none.txt")
    found = io.with_file_bytes(regions.withColumn("file", F.concat(F.lit("of="), "r_regionkey", F.lit("/"), name)), files, "file")
    return found.select("r_regionkey", F.trim(F.regexp_replace(F.col("content").cast("string"), "\n", "")).alias("said"))


# ---- benchmark plans


def _plan(name: str, oracle: str, rows: Callable[[SparkSession, str], DataFrame], choices: tuple[str, ...]) -> None:
    def run(spark, sf_dir):
        return benchmarks.ask(rows(spark, sf_dir), benchmarks.PLANS[name], HashBackend(choices)).select("id", "predicted", "is_correct")

    run.__name__ = f"plan_{name}"
    QUERIES[run.__name__], ORACLES[run.__name__] = run, oracle


def _question_rows(**columns: str) -> Callable[[SparkSession, str], DataFrame]:
    def rows(spark, sf_dir):
        return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("x.png").alias("image"), F.lit("x.png").alias("image_file"), *[F.expr(e).alias(c) for c, e in columns.items()])

    return rows


def _scored(prompt: str, choices: tuple[str, ...], test: str) -> str:
    return f"SELECT id, predicted, CASE WHEN {test} THEN 1 ELSE 0 END AS is_correct FROM (SELECT p_partkey AS id, p_name, p_brand, p_type, p_size, {pick(prompt, *choices)} AS predicted FROM part)"


_YN = "CASE WHEN p_size % 2 = 0 THEN 'yes ' ELSE 'No' END"
_plan("pope", _scored("'Given the question: ' || p_name || ' and image: [image], give me the answer to the question'", ("Yes", "No"), f"lower(predicted) = lower(trim({_YN}))"), _question_rows(question="p_name", answer=_YN), ("Yes", "No"))
_plan("mme", _scored("'Given the question: ' || p_name || ' and image: [image] give me the answer to the question'", ("Yes", "No"), f"lower(predicted) = lower(trim({_YN}))"), _question_rows(question="p_name", answer=_YN), ("Yes", "No"))
_plan("vqav2", _scored("'Given the question: ' || p_name || ' and candidate answers ' || p_brand || ' and ' || p_type || ' and image: [image], give me the answer to the question'", ("red car", "blue"), "contains(predicted, 'red')"), _question_rows(question="p_name", answers="p_brand", answer_type="p_type", multiple_choice_answer="' Red'"), ("red car", "blue"))
_plan("textvqa", "SELECT id, '{\"Answer\":\"' || predicted || '\"}' AS predicted, is_correct FROM (" + _scored("'Given the question: ' || p_name || ' and image: [image], give me the answer to the question'", ("red car", "blue"), "predicted LIKE '%r_d%'") + ")", _question_rows(question="p_name", answers="array('green', ' R_D ')"), ("red car", "blue"))
_plan("ai2d", _scored("'Given the question: ' || p_name || ' and the image: [image]. The candidate answers are: a,b,c. Return only the index number (0, 1, 2, or 3) of the correct answer.'", ("0", "1", "2", "3"), "predicted = (p_size % 3)::VARCHAR"), _question_rows(question="p_name", options="'a,b,c'", answer="p_size % 3"), ("0", "1", "2", "3"))
_plan("hallusion", _scored("'Given the text: ' || p_name || ' and image: [image], give me the answer to the question, return 1 as yes and 0 as no'", ("0", "1"), "predicted = (p_size % 2)::VARCHAR"), _question_rows(question="p_name", gt_answer="p_size % 2"), ("0", "1"))
_plan("chartqa", _scored("'Given the text: ' || p_name || ' image: [image], give me the answer to the question'", ("12 %", "7"), "contains(predicted, '12')"), _question_rows(question="p_name", answer="12"), ("12 %", "7"))
_plan("scivqa", _scored("chr(10) || '        Question: ' || p_name || chr(10) || '        Image: [image]' || chr(10) || '        Figure Caption: ' || p_brand || chr(10) || '        Figure Type: ' || p_type || chr(10) || '        QA Type: None' || chr(10) || '        Answer Options: [\"a\",\"b\"]' || chr(10) || '        '", ("A", "B"), "predicted = 'A'"), _question_rows(question="p_name", caption="p_brand", figure_type="p_type", qa_pair_type="cast(null as string)", answer_options="array('a', 'b')", answer="'a'"), ("A", "B"))
