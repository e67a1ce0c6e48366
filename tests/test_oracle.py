"""Every query with SQL against DuckDB on the smallest tables."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

import seriesloom.queries as core

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def _text(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, int | float) and not isinstance(v, bool):
        return repr(float(v))
    if isinstance(v, datetime.datetime) and v.time() == datetime.time():
        return str(v.date())
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_same_rows(spark, con, name):
    df = core.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(core.oracle_sql()[name])
    assert sorted(want.columns) == cols
    rows = con.sql("SELECT " + ", ".join(f'"{c}"' for c in cols) + f" FROM ({core.oracle_sql()[name]})").fetchall()
    assert sorted(tuple(map(_text, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect()) == sorted(tuple(map(_text, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_has_rows(spark, name):
    assert core.queries()[name](spark, SF).count() > 0
