import pytest

from compare import same_rows
from promptloom.plans import queries as q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_matches_sql(spark, name):
    same_rows(q.QUERIES[name](spark, SF), q.ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLES)))
def test_runs(spark, name):
    assert q.QUERIES[name](spark, SF).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["c_custkey", "n_name"]
    assert set(e.oracle_sql()) <= set(e.queries())
