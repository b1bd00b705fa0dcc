"""Every registered query of the evaluation operators against its DuckDB SQL on the smallest tables."""

import math
import numbers

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from verdigris import catalogue
from verdigris.storage import setting
from verdigris.tables import NAMES


def rows(frame, columns):
    def one(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "~"
        return repr(float(v)) if isinstance(v, numbers.Real) and not isinstance(v, bool) else str(v)

    return sorted(tuple(one(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, sf, duck, name):
    found, expected = catalogue.QUERIES[name](spark, sf).toPandas(), duck.execute(catalogue.ORACLES[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    assert rows(found, columns) == rows(expected, columns)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_rows_are_dealt_by_the_keys_of_a_fixed_list(spark, sf):
    with setting(spark, spark__sql__autoBroadcastJoinThreshold="-1"):  # as for large tables: only what is marked is broadcast
        plans = {name: catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString() for name in ("api_cost", "attribution_rates")}
    assert "BroadcastHashJoin" in plans["api_cost"] and "hashpartitioning" not in plans["api_cost"]
    assert "BroadcastHashJoin" in plans["attribution_rates"] and "hashpartitioning(url" not in plans["attribution_rates"]
