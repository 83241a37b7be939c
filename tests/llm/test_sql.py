"""The queries of the subpackage against their DuckDB SQL, on the smallest tables."""

import os

import duckdb
import pytest

from panelspark.llm import queries

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = con.execute(queries.oracle_sql()[name])
    columns = sorted(c[0] for c in result.description)
    at = [[c[0] for c in result.description].index(c) for c in columns]
    expected = sorted(tuple(r[i] for i in at) for r in result.fetchall())
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == columns
    assert sorted(tuple(r) for r in df.select(*columns).collect()) == expected
