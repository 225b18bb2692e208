"""Named measures that can be evaluated in any grouping, and slicing."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from equigauge.functions.numeric import money_sum, ratio

#: Binary logarithm of the size of a sketch of distinct values.
SKETCH = 12


def _years() -> Column:
    return F.countDistinct("year")


def measure_columns() -> dict[str, Column]:
    """Measures over grid cells. Rates use yearly averages, so periods of any length compare."""
    years = _years()
    population = ratio(F.sum("population"), years)
    cases_per_year = ratio(F.sum("cases"), years)
    return {
        "cases": F.sum("cases").cast("long"),
        "severe": F.sum("severe").cast("long"),
        "deaths": F.sum("deaths").cast("long"),
        "cost": money_sum("cost"),
        "stay_days": F.sum("stay_days").cast("long"),
        "years_in_context": years,
        "population": population,
        "cases_per_year": cases_per_year,
        "annual_rate": ratio(cases_per_year, population, 100_000.0),
        "crude_rate": ratio(F.sum("cases"), F.sum("population"), 100_000.0),
        "severe_frac": ratio(F.sum("severe"), F.sum("cases")),
        "death_frac": ratio(F.sum("deaths"), F.sum("cases")),
        "cost_per_case": ratio(money_sum("cost"), F.sum("cases")),
        "mean_age": ratio(F.sum("age_sum"), F.sum("age_known")),
        "mean_coverage": F.avg("coverage"),
    }


def index_measure_columns(base: str, current: str) -> dict[str, Column]:
    """Measures over the wide index table."""
    return {
        "mean_index_base": F.avg(base),
        "mean_index_current": F.avg(current),
        "mean_change": F.avg("change"),
        "ranked_entities": F.countDistinct("entity"),
    }


def measures(
    df: DataFrame, by: Sequence[str] = (), names: Sequence[str] | None = None,
    registry: dict[str, Column] | None = None,
) -> DataFrame:
    """Evaluate measures for a grouping: one aggregation, only the columns they need are read."""
    registry = measure_columns() if registry is None else registry
    chosen = list(registry) if names is None else list(names)
    return df.groupBy(*by).agg(*[registry[n].alias(n) for n in chosen])


def slice_by_dimension(facts: DataFrame, dimension: DataFrame, key: str, **filters) -> DataFrame:
    """Facts of the members that a filter on their dimension picks, with the dimension's columns.

    Where the facts are partitioned by the key, the members that are left prune their partitions
    before these are read; the filter is never turned into a list by hand.
    """
    return facts.join(slice_by(dimension, **filters), key)


def distinct_cells(df: DataFrame, by: Sequence[str], column: str, log_size: int = SKETCH) -> DataFrame:
    """A sketch of the distinct values of a column for each cell, of at most 2^log_size bytes."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(column, F.lit(log_size)).alias("sketch"))


def distinct_of(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Estimated distinct values of any union of cells. Exact counts can't be put together so."""
    united = cells.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))
    return united.select(*by, F.hll_sketch_estimate("sketch").alias("estimate"))


def distinct_error(log_size: int = SKETCH) -> float:
    """Three standard errors of an estimate, as a share of the true count."""
    return 3 * 1.04 / 2 ** (log_size / 2)


def slice_by(df: DataFrame, **filters) -> DataFrame:
    """Conjunction of equality (or any-of) filters; a column set to None is not filtered."""
    for name, wanted in filters.items():
        if wanted is None:
            continue
        values = list(wanted) if isinstance(wanted, (list, tuple, set)) else [wanted]
        df = df.filter(F.col(name).isin(*values))
    return df


def calibrate_cuts(
    entities: DataFrame, cuts: Sequence[int], by: Sequence[str] = ()
) -> DataFrame:
    """What each volume cut removes: entities out, their share, and population kept.

    ``entities`` is one row per entity with total_cases and population.
    """
    out = F.col("total_cases") < F.col("cut")
    return (
        entities.withColumn("cut", F.explode(F.array(*[F.lit(int(c)) for c in cuts])))
        .groupBy("cut", *by)
        .agg(
            F.count("*").alias("entities"),
            F.count_if(out).alias("entities_out"),
            ratio(F.count_if(out), F.count("*"), 100.0).alias("pct_out"),
            ratio(
                F.sum(F.when(~out, F.col("population"))), F.sum("population"), 100.0
            ).alias("pct_population_kept"),
        )
    )
