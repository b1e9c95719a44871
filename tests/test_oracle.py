"""Each registered query of the engine agrees with its SQL in DuckDB."""

import os

import duckdb
import pytest

from quern.plans.catalogue import ORACLE_SQL, QUERIES

PATH = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(PATH), reason="no test tables")


def rows(columns, found):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in found), key=repr)


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(("q_dml", "q_tx", "q_mig"))])
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{PATH}/{t}.parquet'")
    df = QUERIES[name](spark, PATH)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert rows(columns, df.select(*columns).collect()) == rows(columns, want)


def test_filters_reach_the_scan(spark):
    plan = QUERIES["q_filter_and_or_not"](spark, PATH)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: []" not in plan
    plan = QUERIES["q_project"](spark, PATH)._jdf.queryExecution().executedPlan().toString()
    assert "n_regionkey" not in plan
