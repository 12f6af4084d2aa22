"""Every query with SQL gives what the SQL gives."""

import pytest

import trackloom.queries as core
from oracle import compare

SF = "/root/testdata/sf0.001"


class Core:
    queries, oracle_sql = staticmethod(core.queries), staticmethod(core.oracle_sql)


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query(spark, name):
    assert compare(spark, Core, name, SF) > 0


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_runs(spark, name):
    assert core.queries()[name](spark, SF).count() > 0
