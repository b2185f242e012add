"""Each query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as driver
from tessera.operators import position
from tessera.plans.queries import ORACLES, QUERIES
from tessera.sources.written import written

SF = "/root/testdata/sf0.001"


def normal(columns, rows):
    """Rows by column name, as texts, sorted; floats rounded."""

    def say(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "NULL"
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(say(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = driver.queries()[name](spark, SF)
    rows = df.collect()
    if name not in ORACLES:
        assert rows
        return
    want = duck.sql(ORACLES[name])
    assert normal(df.columns, [tuple(r) for r in rows]) == normal(want.columns, want.fetchall())


def test_entry(spark):
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["sort_by_nodes", "axis_preceding", "axis_following_sibling"])
def test_only_the_import_of_nodes_runs_python(spark, name, monkeypatch):
    """Also in what a query writes on its way."""
    plans = []
    driver.queries()["node_statistics"](spark, SF)  # the import, once
    monkeypatch.setattr(position, "written", lambda df: plans.append(df) or written(df))
    plans.append(driver.queries()[name](spark, SF))
    said = [df._jdf.queryExecution().executedPlan().toString() for df in plans]
    assert len(said) == 1 + (name == "sort_by_nodes") and not any("Python" in x or "Arrow" in x for x in said)
