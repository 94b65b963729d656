"""Every registered query equals its DuckDB twin on the driver's smallest tables."""

import pytest

import __spark_entry__ as entry
from panelcraft.plans import registry
from panelcraft.plans.oracle import oracle_sql
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES = registry.queries()
ORACLE = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, QUERIES[name], ORACLE[name], SF, con)
    assert r["cols_match"], (r["spark_cols"], r["oracle_cols"])
    assert r["spark_rows"] == r["oracle_rows"]
    assert r["hash_match"]


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() >= 0
    from panelcraft.plans.wide import WIDE_COLUMNS

    assert df.columns == WIDE_COLUMNS and len(df.columns) == 49
