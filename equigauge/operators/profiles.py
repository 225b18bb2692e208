"""Rates and ratios by entity, region, or region and sex, for the comparison periods."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from equigauge.config import Study
from equigauge.functions.numeric import ratio
from equigauge.functions.text import nan_to_null
from equigauge.operators.standardize import band_weights, rate_problem, standardize, weighted_rate


def with_period(cells: DataFrame, study: Study) -> DataFrame:
    """Rows of the comparison years, tagged with their period; other years are dropped.

    The year filter comes first, so it reaches the scan or the year list of the grid.
    """
    base, current = study.periods
    years = [*base.years, *current.years]
    label = F.when(F.col("year").isin(*base.years), F.lit(base.label)).otherwise(
        F.lit(current.label)
    )
    return cells.filter(F.col("year").isin(*years)).withColumn("period", label)


def component_ratios(df: DataFrame) -> DataFrame:
    """Fractions per case (0 to 1)."""
    return df.withColumns(
        {
            "severe_frac": ratio(F.col("severe"), F.col("cases")),
            "death_frac": ratio(F.col("deaths"), F.col("cases")),
        }
    )


def _totals() -> list[Column]:
    return [F.sum(c).cast("long").alias(c) for c in ("cases", "severe", "deaths")]


def entity_components(cells: DataFrame, standard: DataFrame, study: Study) -> DataFrame:
    """Components of every entity and period, from the dense grid, in one aggregation."""
    extra = [
        *_totals(),
        F.avg(nan_to_null(F.col("coverage"))).alias("coverage"),
    ]
    # State and region depend on the entity, so they ride along as keys: a hash aggregate cannot
    # carry text values, and a sort of the whole grid would take its place.
    rates = standardize(
        with_period(cells, study),
        ["entity", "period"],
        standard,
        study,
        extra=extra,
        attributes=["state", "region"],
    )
    return component_ratios(rates)


def region_components(cells: DataFrame, standard: DataFrame, study: Study) -> DataFrame:
    """The same by region, over all entities: the ranking cut does not apply here.

    ``cells`` may be the grid, or `additive_cells`, which carry no coverage.
    """
    extra = _totals()
    if "coverage" in cells.columns:
        extra.append(F.avg(nan_to_null(F.col("coverage"))).alias("coverage"))
    rates = standardize(
        with_period(cells, study), ["region", "period"], standard, study, extra=extra
    )
    return component_ratios(rates)


def sex_profile(
    cells: DataFrame, standard: DataFrame, study: Study, keys: Sequence[str] = ("region", "sex")
) -> DataFrame:
    """Two-key profile of the current period, in percent."""
    extra = [
        *_totals(),
        F.sum("age_sum").alias("age_sum"),
        F.sum("age_known").cast("long").alias("age_known"),
    ]
    current = cells.filter(F.col("year").isin(*study.current.years))
    rates = standardize(current, list(keys), standard, study, extra=extra)
    return rates.withColumns(
        {
            "severe_pct": ratio(F.col("severe"), F.col("cases"), 100.0),
            "death_pct": ratio(F.col("deaths"), F.col("cases"), 100.0),
            "mean_age": ratio(F.col("age_sum"), F.col("age_known")),
        }
    )


def entity_components_sparse(
    events: DataFrame,
    population: DataFrame,
    standard: DataFrame,
    study: Study,
    complete: bool = False,
) -> DataFrame:
    """Components of every entity and period without building the grid.

    Gives the rows `entity_components` gives (coverage apart), plus ``total_cases`` over all
    years and the flags of `rank_eligibility`. Events of all kinds of cells collapse to one wide row per short code before their only
    shuffle, and meet one wide population row per entity; the zero cells are never made.

    ``events`` is bronze-like (code, year, sex, band, severe, death); ``population`` has entity,
    code, state, region, sex, band, population. Sexes outside the study have no grid cell and are
    left out, as are rows without a band or with a year outside the study, and events without a
    population cell. ``complete`` says that every entity has all cells of sex and band, so that
    the last need not be looked up.
    """
    labels, n = study.bands.labels, len(study.bands.labels)
    sexes = study.sexes
    rows = events.filter(
        F.col("band").isin(*labels) & F.col("sex").isin(*sexes) & F.col("year").isin(*study.years)
    )
    if not complete:
        cells = population.select("code", "sex", "band")
        rows = rows.join(cells, ["code", "sex", "band"], "left_semi")
    sums: list[Column] = [F.count("*").alias("total_cases")]
    for i, period in enumerate(study.periods):
        here = F.col("year").isin(*period.years)
        sums += [
            F.count_if(here).alias(f"cases_{i}"),
            F.count_if(here & F.col("severe")).alias(f"severe_{i}"),
            F.sum(F.when(here, F.col("death").cast("long")).otherwise(F.lit(0))).alias(
                f"deaths_{i}"
            ),
            F.array(*[F.count_if(here & (F.col("band") == b)) for b in labels]).alias(
                f"bands_{i}"
            ),
        ]
    wide_events = rows.groupBy("code").agg(*sums)
    wide_population = population.groupBy("code", "entity", "state", "region").agg(
        F.array(
            *[
                F.sum(F.when(F.col("band") == b, F.col("population")).otherwise(F.lit(0)))
                for b in labels
            ]
        ).alias("people"),
    )
    zero = F.lit(0).cast("long")
    filled = lambda name: F.coalesce(F.col(name), zero)
    people = lambda years: F.transform(F.col("people"), lambda p: p * F.lit(years))
    period_rows = [
        F.struct(
            F.lit(period.label).alias("period"),
            filled(f"cases_{i}").alias("cases"),
            filled(f"severe_{i}").alias("severe"),
            filled(f"deaths_{i}").alias("deaths"),
            F.coalesce(F.col(f"bands_{i}"), F.array(*[zero] * n)).alias("_cases"),
            people(len(period.years)).alias("_population"),
        )
        for i, period in enumerate(study.periods)
    ]
    enough = F.lit(True)
    for i in range(len(study.periods)):
        enough = enough & (filled(f"cases_{i}") >= study.min_period)
    passed_total = filled("total_cases") >= study.min_total
    # Both periods sit in one row here, so eligibility needs no grouping and no join.
    long = wide_population.join(wide_events, "code", "left").select(
        "entity", "state", "region", filled("total_cases").alias("total_cases"),
        passed_total.alias("passed_total"),
        enough.alias("passed_period"),
        (passed_total & enough).alias("ranked"),
        F.inline(F.array(*period_rows)),
    )
    weighted = long.withColumn("_weights", band_weights(standard, study.bands))
    rates = weighted.select(
        "entity", "state", "region", "period", "cases", "severe", "deaths", "total_cases",
        "passed_total", "passed_period", "ranked",
        weighted_rate(
            F.col("_cases"), F.col("_population"), F.col("_weights"), n, study.per
        ).alias("std_rate"),
        rate_problem(F.col("_cases"), F.col("_population")).alias("problem"),
    )
    return component_ratios(rates)


def period_cells(events: DataFrame, population: DataFrame, study: Study) -> DataFrame:
    """One row per entity and sex with all that components and profiles add up, from one pass.

    For each comparison period ``i`` and band ``j``: ``cases_i``, ``severe_i``, ``deaths_i``,
    ``age_sum_i``, ``age_known_i`` and ``cases_i_j``; ``people_j`` is the population of one year.
    All are sums, so entities, regions, and regions by sex are further sums of these rows. Takes
    what `entity_components_sparse` takes; events without an entity and sex of the population are
    left out, and every entity is expected to have all its bands.
    """
    labels = study.bands.labels
    rows = events.filter(
        F.col("band").isin(*labels) & F.col("sex").isin(*study.sexes) & F.col("year").isin(*study.years)
    )
    sums: list[Column] = [F.count("*").alias("total_cases")]
    for i, period in enumerate(study.periods):
        here = F.col("year").isin(*period.years)
        age = F.when(here, F.col("age_years"))
        sums += [
            F.count_if(here).alias(f"cases_{i}"),
            F.count_if(here & F.col("severe")).alias(f"severe_{i}"),
            F.sum(F.when(here, F.col("death").cast("long")).otherwise(F.lit(0))).alias(f"deaths_{i}"),
            F.coalesce(F.sum(age), F.lit(0.0)).alias(f"age_sum_{i}"),
            F.count(age).alias(f"age_known_{i}"),
            *[F.count_if(here & (F.col("band") == b)).alias(f"cases_{i}_{j}") for j, b in enumerate(labels)],
        ]
    wide = rows.groupBy("code", "sex").agg(*sums)
    people = population.groupBy("code", "entity", "state", "region", "sex").agg(
        *[
            F.sum(F.when(F.col("band") == b, F.col("population")).otherwise(F.lit(0))).alias(f"people_{j}")
            for j, b in enumerate(labels)
        ]
    )
    measures = [c for c in wide.columns if c not in ("code", "sex")]
    return people.join(wide, ["code", "sex"], "left").fillna(0, subset=measures).drop("code")


def cells_by(cells: DataFrame, keys: Sequence[str], study: Study) -> DataFrame:
    """`period_cells` added up by keys, a row for each period, with `cases_by_band` as arrays."""
    n = len(study.bands.labels)
    texts = ("entity", "state", "region", "sex")
    summed = cells.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in cells.columns if c not in texts])
    enough = F.lit(True)
    for i in range(len(study.periods)):
        enough = enough & (F.col(f"cases_{i}") >= study.min_period)
    rows = [
        F.struct(
            F.lit(period.label).alias("period"),
            *[F.col(f"{m}_{i}").alias(m) for m in ("cases", "severe", "deaths", "age_sum", "age_known")],
            F.array(*[F.col(f"cases_{i}_{j}") for j in range(n)]).alias("_cases"),
            F.array(*[F.col(f"people_{j}") * F.lit(len(period.years)) for j in range(n)]).alias("_population"),
        )
        for i, period in enumerate(study.periods)
    ]
    return summed.select(
        *keys, "total_cases", (F.col("total_cases") >= study.min_total).alias("passed_total"),
        enough.alias("passed_period"), F.inline(F.array(*rows)),
    ).withColumn("ranked", F.col("passed_total") & F.col("passed_period"))


def components_of(
    cells: DataFrame, keys: Sequence[str], standard: DataFrame, study: Study
) -> DataFrame:
    """Components by keys and period from `period_cells`."""
    rows = cells_by(cells, keys, study).withColumn("_weights", band_weights(standard, study.bands))
    rate = weighted_rate(
        F.col("_cases"), F.col("_population"), F.col("_weights"), len(study.bands.labels), study.per
    )
    rates = rows.withColumns(
        {"std_rate": rate, "problem": rate_problem(F.col("_cases"), F.col("_population"))}
    )
    return component_ratios(rates.drop("_cases", "_population", "_weights"))
