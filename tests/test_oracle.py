"""Every registered analysis against its DuckDB twin on the shared Parquet
tables (the driver does the same at sf0.01; here sf0.001 by default)."""

import os

import pytest

import __spark_entry__ as E
from funnelkit.plans import registry
from tools.oracle_compare import SPARK_TO_DUCK, duck, rows_of

SF_DIR = os.environ.get("FUNNELKIT_ORACLE_DIR", "/root/testdata/sf0.001")
QUERIES = registry.queries()
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_a_twin():
    assert set(QUERIES) <= set(SQL)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_matches_oracle(spark, con, key):
    sdf = QUERIES[key](spark, SF_DIR)
    s_cols, s_rows = sdf.columns, [tuple(r) for r in sdf.collect()]
    rel = con.sql(SQL[key])
    d_cols, d_rows = rel.columns, rel.fetchall()
    assert sorted(s_cols) == sorted(d_cols)
    s_types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString()) for f in sdf.schema.fields}
    assert s_types == {c: str(t) for c, t in zip(d_cols, rel.types)}
    assert rows_of(s_cols, s_rows) == rows_of(d_cols, d_rows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "event_date" in df.columns
