"""Every query of the library against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from poseflow.plans import queries
from poseflow.plans.views import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(x):
    if isinstance(x, float):
        return "None" if math.isnan(x) else "0" if abs(x) < 1e-9 else f"{x:.6g}"
    return str(x)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, con, name):
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    number = lambda v: float(v) if isinstance(v, int) and not isinstance(v, bool) else v
    rows = lambda rs: sorted(tuple(shown(number(x)) for x in r) for r in rs)
    assert rows(df.select(*names).collect()) == rows(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3 and set(e.oracle_sql()) <= set(e.queries())
