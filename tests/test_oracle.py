"""Every registered query against its DuckDB SQL on the smallest driver tables."""

import os

import pytest

import __spark_entry__ as E
from tools.check_oracle import compare, connect

SF = "/root/testdata/sf0.001"
NAMES = sorted(E.oracle_sql())  # queries without SQL have tests of their own


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("driver tables not present")
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    problems = compare(spark, con, SF, name, E.queries()[name], E.oracle_sql().get(name))
    assert not problems, problems


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["doc_id", "prediction", "gold"]
    assert df.count() > 0
