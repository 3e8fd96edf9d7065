"""Differential test: every registered query against its DuckDB twin (sf0.001), plus the entry smoke."""

import pytest

import __spark_entry__ as E
from fleetstops.registry import QUERIES
from tests.conftest import SF_SMALL
from tests.oracle_check import duck, normalise

# The training-data operators have their own tests in tests/llm.
NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(NAMES) <= set(E.oracle_sql()) & set(E.queries())
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["report_time", "vehicle_tag", "stopped_for"]
    assert df.count() == 26


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_duckdb(spark, con, name):
    sdf = E.queries()[name](spark, SF_SMALL).toPandas()
    ddf = con.execute(E.oracle_sql()[name]).df()
    assert sorted(sdf.columns) == sorted(ddf.columns)
    for c in sdf.columns:
        assert str(sdf[c].dtype).split("[")[0] == str(ddf[c].dtype).split("[")[0], c
    assert normalise(sdf) == normalise(ddf)
