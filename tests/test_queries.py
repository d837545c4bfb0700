"""Every registered query of the engine against its SQL on DuckDB."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from streamlens import registry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, (float, Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return str([_plain(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, database, name):
    df = registry.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    cursor = database.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(_plain(r[i]) for i in at) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_repeats_itself(spark, name):
    rows = [sorted(map(str, registry.queries()[name](spark, str(DATA)).collect())) for _ in range(2)]
    assert rows[0] and rows[0] == rows[1]
