"""Every registered query against its DuckDB oracle on sf0.001 (the driver uses sf0.01)."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.conftest import SF_SMALL
from tests.oracle_check import compare, duck


@pytest.fixture(scope="module")
def con(spark):
    spark.catalog.clearCache()
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, SF_SMALL)
    # a registered query leaves no cached table behind
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == 0
    if name in oracle_sql():
        assert r["columns_match"] and r["values_match"], r
    else:
        assert r["spark_rows"] > 0


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["id", "rank"]
    assert df.count() == 10
