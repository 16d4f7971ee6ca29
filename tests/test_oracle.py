"""Every registered query against its DuckDB oracle at sf0.001; those without one, which have
brute-force tests of their own, must at least give rows."""

import os

import pytest

from __spark_entry__ import oracle_sql, queries
from tempora.plans.verify import compare, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    if name in oracle_sql():
        r = compare(spark, name, SF, con, queries()[name], oracle_sql()[name])
        assert r["values_match"], r
    else:
        df = queries()[name](spark, SF)
        assert df.count() > 0 and len(df.columns) > 0


def test_entry(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    assert df.count() > 0
