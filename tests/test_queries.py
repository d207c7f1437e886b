"""Every query that has SQL gives the SQL's rows at the smallest scale."""

import pytest

from jobloom.plans import job_queries, metric_queries, more_queries, state_queries  # noqa: F401
from jobloom.plans.registry import PLANS, SQL, queries
from tests.same_rows import compare, connect

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    compare(queries()[name](spark, DIR), con, SQL[name])


@pytest.mark.parametrize("name", sorted(PLANS.keys() - SQL.keys()))
def test_runs(spark, name):
    rows = queries()[name](spark, DIR).collect()
    assert rows and len(set(map(str, rows))) > 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
