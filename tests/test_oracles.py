"""Every query with an oracle, on the smallest tables: same rows from Spark and from DuckDB."""

import glob
import math
import os

import duckdb
import pytest

from textloom.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(frame, columns):
    def one(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "NULL"
        if isinstance(x, float):
            return str(int(x)) if x == int(x) else f"{x:.6f}"
        return str(list(x)) if hasattr(x, "__iter__") and not isinstance(x, str) else str(x)

    return sorted(tuple(map(one, r)) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, db, name):
    got = catalog.queries()[name](spark, DATA).toPandas()
    wanted = db.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    columns = sorted(got.columns)
    assert plain(got, columns) == plain(wanted, columns)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs_without_oracle(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0
