"""Each core query against its SQL, over the driver's tables where they are there."""

import os

import duckdb
import pytest

from quernel import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def test_every_query_has_sql():
    assert queries.queries().keys() == queries.oracle_sql().keys()


@pytest.mark.parametrize("name", queries.queries())
def test_against_sql(spark, db, name):
    got, want = queries.queries()[name](spark, SF).toPandas(), db.execute(queries.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    a, b = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert a.equals(b)
