"""The dense grid: every population cell of every year, with zeros kept."""

from __future__ import annotations

from functools import reduce
from operator import add
from typing import Sequence

from pyspark.sql import DataFrame, functions as F

from equigauge.config import Study
from equigauge.operators import CELL, GOLD_COLUMNS, MEASURES


def population_years(population: DataFrame, years: Sequence[int]) -> DataFrame:
    """Population cells repeated for each year of a fixed list.

    The years are a literal array exploded in place: no join and no shuffle.
    """
    return population.withColumn("year", F.explode(F.array(*[F.lit(int(y)) for y in years])))


def fill_measures(grid: DataFrame, events: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Left join of the events onto the grid; cells without events hold zeros."""
    measures = [m for m in MEASURES if m in events.columns]
    return grid.join(events.select(*keys, *measures), list(keys), "left").fillna(
        0, subset=measures
    )


def add_coverage(cells: DataFrame, coverage: DataFrame) -> DataFrame:
    """Attach the yearly coverage. It repeats over sex and band: average it, never sum it."""
    return cells.join(
        coverage.select("entity", "year", "coverage"), ["entity", "year"], "left"
    )


def dense_grid(
    population: DataFrame,
    years: Sequence[int],
    events: DataFrame,
    coverage: DataFrame | None = None,
) -> DataFrame:
    """Population x years, events filled with zero, and coverage where it is known."""
    gold = fill_measures(population_years(population, years), events)
    gold = (
        add_coverage(gold, coverage)
        if coverage is not None
        else gold.withColumn("coverage", F.lit(None).cast("double"))
    )
    return gold.select(*[c for c in GOLD_COLUMNS if c in gold.columns])


def additive_cells(
    population: DataFrame, years: Sequence[int], events: DataFrame, complete: bool = False
) -> DataFrame:
    """Rows that add up to what the dense grid adds up to, without the grid's join.

    Every population cell comes once per year with zero measures, and every event row with zero
    population, so any grouping of sums is the same as over `dense_grid` and needs one shuffle of
    already combined rows. Not for counting cells or for averages over cells. Events without a
    complete key, outside the years or without a population cell are left out. ``complete`` says
    that every entity has all cells of sex and band, so that the last need not be looked up.
    """
    measures = [m for m in MEASURES if m in events.columns]
    attributes = [c for c in ("state", "region") if c in population.columns]
    keys = [*CELL, *attributes]
    zeros = population_years(population.select("entity", "sex", "band", *attributes, "population"),
                             years)
    zeros = zeros.select(
        *keys, "population",
        *[F.lit(0).cast(events.schema[m].dataType).alias(m) for m in measures],
    )
    known = events.filter(F.col("year").isin(*[int(y) for y in years])).dropna(subset=list(CELL))
    if not complete:
        known = known.join(
            population.select("entity", "sex", "band"), ["entity", "sex", "band"], "left_semi"
        )
    rows = known.select(*keys, F.lit(0).cast("long").alias("population"), *measures)
    return zeros.unionByName(rows)


def grid_size(gold: DataFrame, study: Study) -> DataFrame:
    """Rows of the grid against the product of its keys.

    The small keys have known values, so their presence is a set of flags; counting several
    distinct columns at once would instead multiply the rows of the grid.
    """
    known = {"year": study.years, "sex": study.sexes, "band": study.bands.labels}
    flags = {f"{k}_{i}": F.col(k) == v for k, vs in known.items() for i, v in enumerate(vs)}
    entities = gold.groupBy("entity").agg(
        F.count("*").alias("rows"), *[F.bool_or(c).alias(n) for n, c in flags.items()]
    )
    seen = entities.agg(
        F.sum("rows").alias("rows"),
        F.count("entity").alias("n_entity"),
        *[F.bool_or(n).cast("long").alias(n) for n in flags],
    )
    present = lambda k: reduce(add, [F.col(n) for n in flags if n.startswith(f"{k}_")])
    sizes = seen.select(
        "rows", "n_entity", *[present(k).alias(f"n_{k}") for k in ("year", "sex", "band")]
    )
    expected = F.col("n_entity") * F.col("n_year") * F.col("n_sex") * F.col("n_band")
    return sizes.withColumn("expected", expected).withColumn(
        "complete", F.col("rows") == F.col("expected")
    )
