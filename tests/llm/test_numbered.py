"""Every numbered query with SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import pytest
import test_oracle as plain

from sentinelle.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in plain.TABLES.split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = registry.queries()[name](spark, SF)
    want = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert plain.rows(got.columns, got.collect()) == plain.rows(columns, want.fetchall())


def test_all_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))
