"""The operators marked native run no Python on the executors."""

import inspect

import pytest

from promptloom.llm import decontam, exact, mixing, queries, secrets, urltree

SF = "/root/testdata/sf0.001"
NATIVE = {"op1_secret_scans": secrets, "op2_benchmark_decontamination": decontam, "op3_url_filters": urltree, "op7_exact_dedup": exact, "op9_mixing": mixing}


@pytest.mark.parametrize("name", sorted(NATIVE))
def test_native(spark, name):
    text = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in text for word in ("Python", "Arrow", "Pandas", "CartesianProduct"))
    source = inspect.getsource(NATIVE[name])
    assert not any(word in source for word in ("pandas", "mapIn", "applyIn", ".rdd", "crossJoin"))


def test_rules_run_above_the_join_with_unseen_blobs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = secrets.scan(secrets.unseen(docs, None))._jdf.queryExecution().optimizedPlan().toString()
    below = text[text.index("Join Inner") :]
    assert "regexp_extract_all" not in below
