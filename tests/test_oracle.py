"""Every query with an oracle equals DuckDB on the same parquet (sf0.001);
the driver repeats this at sf0.01."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tests.oracle_util import compare, duck_connect

ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_duckdb(spark, con, name):
    r = compare(E.queries()[name](spark, SF_SMALL), ORACLE[name], con)
    assert r["ok"], r


def test_contract(spark):
    assert set(ORACLE) <= set(E.queries())
    df = E.entry(spark)
    assert df.count() >= 0 and "f1_macro" in df.columns
