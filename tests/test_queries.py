"""Every registered query of the panel library against its DuckDB SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from panelspark import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v.isoformat()[:19] if hasattr(v, "isoformat") else v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = ordered(tuple(map(plain, r)) for r in df.select(*columns).collect())
    result = duck.execute(queries.SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    expected = ordered(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert len(found) == len(expected)
    for a, b in zip(found, expected, strict=True):
        assert a == pytest.approx(b, abs=2e-5, rel=1e-9, nan_ok=True) if all(isinstance(x, float) for x in (*a, *b)) else all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5 + 1e-9 * abs(y)) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_without_sql(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
