"""Every query with SQL gives DuckDB's rows, names and kinds."""

import os

import duckdb
import pytest

from neurograph.plans import registry

SF = "/root/testdata/sf0.001"
KINDS = {"bigint": ("BIGINT",), "double": ("DOUBLE",), "string": ("VARCHAR",), "boolean": ("BOOLEAN",)}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, con, name):
    df, want = registry.QUERIES[name](spark, SF), con.sql(registry.SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    assert all(kinds[c] in KINDS[k] for c, k in df.dtypes)
    quoted = ", ".join(f'"{c}"' for c in cols)
    rows = sorted(map(repr, map(tuple, df.select(*[f"`{c}`" for c in cols]).collect())))
    assert rows == sorted(map(repr, want.select(quoted).fetchall()))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)
