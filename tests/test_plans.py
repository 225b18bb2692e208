"""Plans that the layouts are for."""

import re

import pytest

from equigauge.plans.catalogue.layers import pruning_tables
from equigauge.plans.workload import Layers
from equigauge.operators.measures import distinct_cells, distinct_error, distinct_of, slice_by_dimension
from equigauge.operators.scale import apply_scale, index_change
from equigauge.sinks.bucketed import LEAST_BUCKETS, bucket_count, write_bucketed

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def layers(spark):
    return Layers(spark, FOLDER)


@pytest.fixture
def shuffled_joins(spark):
    """No side of a join is small enough to be sent to all tasks, as at full size."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold",
             "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold")
    for name in names:
        spark.conf.set(name, "-1" if "Map" not in name else "0")
    yield
    for name in names:
        spark.conf.unset(name)


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def exchanges(plan):
    return re.findall(r"Exchange (\w+)", plan)


def test_the_grid_is_joined_without_a_shuffle(layers, shuffled_joins):
    plan = plan_of(layers.gold_colocated)
    assert plan.count("SortMergeJoin") == 2 and exchanges(plan) == []
    assert f"SelectedBucketsCount: {LEAST_BUCKETS} out of {LEAST_BUCKETS}" in plan
    # The same layers as they come: every side is shuffled.
    assert len(exchanges(plan_of(layers.gold_covered))) > 3


def test_both_periods_meet_without_a_shuffle(layers, shuffled_joins):
    change = index_change(apply_scale(layers.ranked_colocated, layers.ruler, layers.study), layers.study)
    main = plan_of(change).split("Subquery")[0]
    assert "hashpartitioning" not in exchanges(main)
    rows = lambda df: {r["entity"]: r["change"] for r in df.collect()}
    assert rows(change) == pytest.approx(rows(layers.change))


def test_buckets_hold_all_rows(spark):
    df = spark.range(1000).selectExpr("id % 37 AS key", "id", "cast(null as string) AS nothing")
    table = write_bucketed(df.union(df.selectExpr("null", "id", "'x'")), "some", "key", 3)
    assert table.count() == 2000 and table.filter("key IS NULL").count() == 1000
    assert len(table.inputFiles()) == 3
    assert bucket_count(0) == LEAST_BUCKETS and bucket_count(10**9) == 250


def test_a_filter_on_the_dimension_prunes_partitions(layers):
    facts, time = pruning_tables(layers)
    chosen = slice_by_dimension(facts, time, "year", block="1997-98")
    plan = plan_of(chosen)
    assert "dynamicpruning" in plan
    leaves = chosen._jdf.queryExecution().executedPlan().finalPhysicalPlan().collectLeaves()
    read = []
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        nodes = leaf.plan().collectLeaves() if "QueryStage" in leaf.getClass().getSimpleName() else None
        node = nodes.apply(0) if nodes else leaf
        if node.metrics().contains("numPartitions"):
            read.append(node.metrics().apply("numPartitions").value())
    years = {r["year"] for r in facts.select("year").distinct().collect()}
    assert read == [2] and len(years) > 2
    assert {r["year"] for r in chosen.select("year").distinct().collect()} == {1997, 1998}


def test_distinct_counts_of_united_cells(spark):
    rows = [(i % 5, i % 3, f"e{i % 20_000}") for i in range(60_000)] + [(0, 0, None)]
    df = spark.createDataFrame(rows, "a int, b int, e string")
    cells = distinct_cells(df, ["a", "b"], "e")
    assert cells.count() == 15
    whole = distinct_of(cells).first()["estimate"]
    assert abs(whole - 20_000) <= distinct_error() * 20_000
    exact = {r["a"]: r["n"] for r in df.selectExpr("a", "e").distinct().groupBy("a").agg({"e": "count"}).toDF("a", "n").collect()}
    for r in distinct_of(cells, ["a"]).collect():
        assert abs(r["estimate"] - exact[r["a"]]) <= distinct_error() * exact[r["a"]]
    assert distinct_of(distinct_cells(df.limit(0), ["a"], "e"), ["a"]).count() == 0


def test_one_pass_over_the_records(spark):
    """Entities, regions and sexes read the records once, when the shared pass is written."""
    d = Layers(spark, FOLDER)
    seen = []
    df = d.regions
    for table in (d.bronze, d.shared_pass, d.ranked, df, d.shared_components(["region", "sex"])):
        seen.append(sum("lineitem" in f for f in table.inputFiles()))
    assert seen == [1, 0, 0, 0, 0]


def test_shared_and_sparse_components_agree(spark):
    d = Layers(spark, FOLDER)
    names = ("cases", "severe", "deaths", "total_cases", "ranked", "std_rate", "severe_frac", "problem")
    rows = lambda df: {(r["entity"], r["period"]): tuple(r[n] for n in names) for r in df.collect()}
    shared, sparse = rows(d.shared_components(["entity", "state", "region"])), rows(d.components)
    assert set(shared) == set(sparse)
    for key, row in sparse.items():
        assert shared[key] == pytest.approx(row), key
