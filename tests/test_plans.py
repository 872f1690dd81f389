"""What Catalyst makes of the operators: what reaches the scan, and how often models run."""

from promptloom.functions.backends import RecordedBackend
from promptloom.operators import layout, semantic
from promptloom.plans import queries as q

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_columns_and_filters_reach_the_scan(spark):
    text = plan(q.sem_cascade(spark, SF))
    assert "EqualTo(o_orderstatus,F)" in text
    assert "o_totalprice" not in text and "c_acctbal" not in text
    assert "Python" not in plan(q.sem_filter(spark, SF))  # the hash backend stays in the JVM


def test_chained_predicates_stay_apart(spark):
    df = spark.range(10)
    said = RecordedBackend({})
    steps = [semantic.Step("a {id}"), semantic.Step("b {id}")]
    text = plan(semantic.cascade(df, steps, said, dedup=False))
    assert text.count("ArrowEvalPython") == 2


def test_limit_runs_below_inference(spark):
    text = plan(semantic.sem_map(spark.range(100), "a {id}", "r", RecordedBackend({}), dedup=False).limit(3))
    assert text.index("ArrowEvalPython") < text.index("LocalLimit") or text.index("ArrowEvalPython") > text.index("GlobalLimit")


def test_small_side_of_a_semantic_join_is_broadcast(spark):
    assert "BroadcastNestedLoopJoin" in plan(q.sem_join_cross(spark, SF))


def test_fixed_reorder_is_dealt_by_range(spark):
    text = plan(layout.fixed_reorder(q.table(spark, SF, "part"), "p_brand", "p_type", partitions=4))
    assert "rangepartitioning" in text and "SinglePartition" not in text
