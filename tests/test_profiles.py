"""Sparse and dense ways to the same numbers, with one entity holding a third of all records."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from equigauge import health_study
from equigauge.operators.grid import additive_cells, dense_grid
from equigauge.operators.profiles import (
    entity_components, entity_components_sparse, region_components, sex_profile,
)
from equigauge.operators.eligibility import rank_eligibility
from equigauge.operators.rollup import expand_code, merge_cells, roll_up
from equigauge.operators.standardize import standard_population

STUDY = health_study()
ENTITIES = [("3550308", "SP", "Sudeste"), ("2304400", "CE", "Nordeste"), ("1200013", "AC", "Norte"),
            ("4300034", "RS", "Sul"), ("5200050", "GO", "Centro-Oeste"), ("3300100", "RJ", "Sudeste")]


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(21)
    n = 1500
    codes = [e[:6] for e, _, _ in ENTITIES[:5]] + ["999999"]
    code = np.where(rng.random(n) < 1 / 3, codes[0], rng.choice(codes, n))
    bands = [*STUDY.bands.labels, None]
    records = [
        (str(c), str(rng.choice(["F", "M", "?"], p=[0.5, 0.45, 0.05])), float(rng.integers(20, 90)),
         bands[rng.integers(8)], int(rng.integers(2018, 2026)), 1, bool(rng.random() < 0.2),
         int(rng.random() < 0.1), 10.5, 2)
        for c in code
    ]
    bronze = spark.createDataFrame(
        records, "code string, sex string, age_years double, band string, year int, month int, "
                 "severe boolean, death int, cost double, stay_days int").repartition(6)
    people = [(e, e[:6], s, r, x, b, int(rng.integers(50, 500)))
              for e, s, r in ENTITIES for x in STUDY.sexes for b in STUDY.bands.labels]
    population = spark.createDataFrame(
        people, "entity string, code string, state string, region string, sex string, "
                "band string, population long")
    lookup = population.select("code", "entity", "state", "region").distinct()
    known = roll_up(bronze).filter(F.col("sex").isin("F", "M"))
    with_places = expand_code(known, lookup)
    gold = dense_grid(population.drop("code"), STUDY.years, merge_cells(with_places))
    return {
        "bronze": bronze, "population": population, "gold": gold, "events": with_places,
        "standard": standard_population(population, STUDY.bands),
        "records": pd.DataFrame(records, columns=bronze.columns),
        "people": pd.DataFrame(people, columns=population.columns),
    }


def by(df, *keys):
    return df.toPandas().set_index(list(keys)).sort_index()


def test_additive_cells_add_up_like_the_grid(world):
    cells = additive_cells(world["population"], STUDY.years, world["events"])
    sums = [F.sum(c).alias(c) for c in ("cases", "severe", "deaths", "cost", "population", "age_sum")]
    for keys in (["entity", "year", "sex", "band"], ["region", "year"], ["state", "sex"]):
        got, expected = (by(df.groupBy(*keys).agg(*sums), *keys) for df in (cells, world["gold"]))
        pd.testing.assert_frame_equal(got, expected, check_dtype=False)


def test_events_without_a_population_cell_count_nowhere(world):
    gone = (F.col("sex") == "F") & (F.col("band") == STUDY.bands.labels[1])
    holed = world["population"].filter(~gone)
    assert world["events"].filter(gone).count() > 0
    cells = additive_cells(holed, STUDY.years, world["events"])
    grid = dense_grid(holed, STUDY.years, world["events"])
    sums = [F.sum(c).alias(c) for c in ("cases", "severe", "population")]
    got, expected = (by(df.groupBy("entity", "year").agg(*sums), "entity", "year") for df in (cells, grid))
    pd.testing.assert_frame_equal(got, expected, check_dtype=False)


def test_sparse_components_with_holes_match_the_grid(world):
    gone = (F.col("sex") == "F") & (F.col("band") == STUDY.bands.labels[1])
    holed = world["population"].filter(~gone)
    columns = ["cases", "severe", "deaths", "std_rate", "severe_frac", "death_frac"]
    sparse = by(entity_components_sparse(
        world["bronze"], holed, world["standard"], STUDY), "entity", "period")
    grid = dense_grid(holed, STUDY.years, world["events"])
    dense = by(entity_components(grid, world["standard"], STUDY), "entity", "period")
    pd.testing.assert_frame_equal(sparse[columns], dense[columns], check_dtype=False)


def test_sparse_components_match_grid_and_brute_force(world):
    columns = ["cases", "severe", "deaths", "std_rate", "severe_frac", "death_frac"]
    sparse = by(entity_components_sparse(
        world["bronze"], world["population"], world["standard"], STUDY), "entity", "period")
    dense = by(entity_components(world["gold"], world["standard"], STUDY), "entity", "period")
    assert len(sparse) == 2 * len(ENTITIES)
    pd.testing.assert_frame_equal(sparse[columns], dense[columns], check_dtype=False)

    records, people = world["records"], world["people"]
    weights = people.groupby("band")["population"].sum()
    weights = weights / weights.sum()
    for (entity, period), row in sparse.iterrows():
        years = (2019,) if period == "2019" else (2023, 2024)
        mine = records[(records["code"] == entity[:6]) & records["year"].isin(years)
                       & records["band"].notna() & records["sex"].isin(["F", "M"])]
        cases = mine.groupby("band").size().reindex(weights.index, fill_value=0)
        pop = people[people["entity"] == entity].groupby("band")["population"].sum() * len(years)
        assert row["cases"] == len(mine) and row["severe"] == mine["severe"].sum()
        assert row["std_rate"] == pytest.approx((cases / pop * weights).sum() * 1e5)


def test_flags_match_the_general_rules(world):
    sparse = entity_components_sparse(
        world["bronze"], world["population"], world["standard"], STUDY)
    totals = world["gold"].groupBy("entity").agg(F.sum("cases").alias("total_cases"))
    dense = entity_components(world["gold"], world["standard"], STUDY)
    general = by(rank_eligibility(dense, totals, STUDY), "entity", "period")
    flags = ["total_cases", "passed_total", "passed_period", "ranked"]
    pd.testing.assert_frame_equal(
        by(sparse, "entity", "period")[flags], general[flags], check_dtype=False)


def test_region_and_sex_profiles_from_cells(world):
    cells = additive_cells(world["population"], STUDY.years, world["events"])
    for keys, build in ((("region", "period"), region_components), (("region", "sex"), sex_profile)):
        got = by(build(cells, world["standard"], STUDY), *keys)
        expected = by(build(world["gold"], world["standard"], STUDY), *keys)
        pd.testing.assert_frame_equal(
            got, expected[got.columns], check_dtype=False)


def test_mean_age_of_known_ages(spark, world):
    row = sex_profile(world["gold"].withColumns({"age_sum": F.lit(0.0), "age_known": F.lit(0)}),
                      world["standard"], STUDY).first()
    assert row["mean_age"] is None
