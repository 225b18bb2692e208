"""Registered queries: contract, plans, and a sample against DuckDB on the smallest tables."""

import pathlib

import duckdb
import pytest

import __spark_entry__ as entry_points
from equigauge.plans.workload import Layers
from tools.compare import rows_of

FOLDER = pathlib.Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="given tables are not here")

SAMPLE = [
    "silver_rollup", "dense_grid_by_state", "entity_components_from_records", "entity_index",
    "index_changes", "region_index", "weight_scheme_sensitivity", "rank_correlation",
    "exact_quantiles", "external_reconciliation", "fixed_width_records", "census_bands",
    "crosstab_totals", "stream_cohort", "ranking_funnel", "export_round_trip",
]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


@pytest.fixture(scope="module")
def layers(spark):
    return Layers(spark, str(FOLDER))


def test_registry():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert len(entry_points.queries()) > 100


def test_flagship(spark):
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, db, name):
    df = entry_points.queries()[name](spark, str(FOLDER))
    result = db.execute(entry_points.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, result.fetchall())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_index_plans_have_no_cartesian_joins_and_no_python(layers):
    for df in (layers.components, layers.components_dense, layers.gold_covered, layers.index,
               layers.regions, layers.sexes, layers.wide):
        plan = plan_of(df)
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        assert "Python" not in plan and "ArrowEval" not in plan


def test_components_use_hash_aggregation_only(layers):
    plan = plan_of(layers.components)
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_scans_read_only_needed_columns(layers):
    plan = plan_of(layers.bronze.groupBy("year").count())
    line_scan = next(p for p in plan.splitlines() if "FileScan" in p and "lineitem" in p)
    assert "l_extendedprice" not in line_scan and "l_shipdate" not in line_scan


def test_year_filter_reaches_the_orders_scan(layers):
    plan = layers.bronze.filter("year = 1996")._jdf.queryExecution().optimizedPlan().toString()
    filters = [p for p in plan.splitlines() if "Filter" in p and "o_orderdate" in p]
    assert any("1996" in p for p in filters)
