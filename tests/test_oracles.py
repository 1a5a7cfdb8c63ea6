"""Every registered query of the engine against its DuckDB oracle, at the smallest scale."""

import os

import duckdb
import pytest

from semlake.fixtures import GIVEN
from semlake.plans import registry

SF = os.environ.get("SEMLAKE_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if v is None or (isinstance(v, float) and v != v) or str(v) in ("NaT", "<NA>"):
        return "NULL"
    return float(f"{v:.9g}") if isinstance(v, float) else v


def rows(df, cols):
    return sorted((tuple(plain(v) for v in r) for r in df[cols].astype(object).itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in GIVEN:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    sql = registry.oracles().get(name)
    if sql is None:
        assert len(got)
        return
    want = duck.sql(sql).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert rows(got, cols) == rows(want, cols)
