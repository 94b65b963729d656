"""The queries with a DuckDB twin give the same rows."""

import duckdb
import pytest

from panelcraft.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    res = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in res.description]
    df = registry.queries()[name](spark, sf)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(columns).collect()), key=str) == sorted(res.fetchall(), key=str)
