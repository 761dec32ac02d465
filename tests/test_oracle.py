"""Every registered query against its SQL on the smallest tables, and plan checks for all of them."""

from __future__ import annotations

import os
import sys

import pytest

duckdb = pytest.importorskip("duckdb")

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check_oracle import TABLES, canonical  # noqa: E402

from voltframe.workload import ORACLE, QUERIES  # noqa: E402

SF_DIR = os.environ.get("VOLTFRAME_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not available")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    physical = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in physical and "NestedLoopJoin" not in physical
    got, want = canonical(df.toPandas()), canonical(con.execute(ORACLE[name]).fetchdf())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for column in got.columns:
        assert got[column].tolist() == want[column].tolist(), column


def test_only_fitted_models_lack_sql():
    assert set(QUERIES) - set(ORACLE) == {"gbt_quantile_forecast", "leaf_quantile_forecast", "model_zoo", "feature_importance"}
