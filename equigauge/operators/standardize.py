"""Direct standardisation of rates to a reference population structure."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from equigauge.config import Bands, Study
from equigauge.functions.text import nan_to_null


def standard_population(population: DataFrame, bands: Bands) -> DataFrame:
    """Population per band: at most one row per configured label."""
    return (
        population.filter(F.col("band").isin(*bands.labels))
        .groupBy("band")
        .agg(F.sum("population").alias("population"))
    )


def band_weights(standard: DataFrame, bands: Bands) -> Column:
    """Share of each band in the whole standard, as an array in band order.

    Returned as a scalar subquery: one row, computed once, no join.
    """
    total = F.sum(F.when(F.col("band").isin(*bands.labels), F.col("population")))
    shares = [
        F.coalesce(F.sum(F.when(F.col("band") == label, F.col("population"))), F.lit(0)).cast(
            "double"
        )
        / total
        for label in bands.labels
    ]
    return standard.agg(F.array(*shares).alias("weights")).scalar()


def band_sums(bands: Bands, cases: str = "cases", population: str = "population") -> list[Column]:
    """Per-band sums as arrays, so one aggregation by group is enough (no second shuffle)."""
    in_band = lambda label, value: F.sum(
        F.when(F.col("band") == label, F.coalesce(nan_to_null(F.col(value)), F.lit(0.0)))
    )
    return [
        F.array(*[F.coalesce(in_band(b, cases), F.lit(0.0)) for b in bands.labels]).alias(
            "_cases"
        ),
        F.array(*[F.coalesce(in_band(b, population), F.lit(0.0)) for b in bands.labels]).alias(
            "_population"
        ),
    ]


def weighted_rate(cases: Column, population: Column, weights: Column, n: int, per: float) -> Column:
    """Sum over bands of cases/population * weight * per.

    A band without population adds zero and keeps its weight.
    """
    terms = [
        F.when(population[i] > 0, cases[i] / population[i]).otherwise(F.lit(0.0)) * weights[i]
        for i in range(n)
    ]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total * F.lit(float(per))


def without_population(population: Column) -> Column:
    """True when no band has population: there is no denominator."""
    return ~F.exists(population, lambda p: p > 0)


def orphan_cases(cases: Column, population: Column) -> Column:
    """True when a band has cases and no population: an infinite rate."""
    return F.exists(F.arrays_zip(cases.alias("c"), population.alias("p")),
                    lambda z: (z["c"] > 0) & ~(z["p"] > 0))


def standardize(
    df: DataFrame,
    keys: Sequence[str],
    standard: DataFrame,
    study: Study,
    cases: str = "cases",
    population: str = "population",
    extra: Sequence[Column] = (),
    attributes: Sequence[str] = (),
    aggregated: bool = False,
) -> DataFrame:
    """Standardised rate per group, plus its problems and any ``extra`` aggregates.

    Groups are aligned to all bands of the standard; bands outside it are ignored; rows with a
    null key are dropped. ``attributes`` are columns that depend on the keys and are kept as they
    are. ``problem`` is null for a sound group; `sound` and `check_standardized` raise on it, and
    a group without population has no rate. ``aggregated`` promises one row per group and band,
    so that a band that comes twice is a problem, too.
    """
    n = len(study.bands.labels)
    in_band = [F.count_if(F.col("band") == b) for b in study.bands.labels]
    most = [F.array_max(F.array(*in_band)).alias("_most")] if aggregated else []
    sums = (
        df.dropna(subset=list(keys))
        .groupBy(*keys, *attributes)
        .agg(*band_sums(study.bands, cases, population), *most, *extra)
    )
    named = [c for c in sums.columns if c not in ("_cases", "_population", "_most")]
    problem = rate_problem(F.col("_cases"), F.col("_population"))
    if aggregated:
        twice = F.when(F.col("_most") > 1, F.lit("a band occurs more than once"))
        problem = F.coalesce(problem, twice)
    # As a column of its own the subquery is planned once, not once per band.
    weighted = sums.withColumn("_weights", band_weights(standard, study.bands))
    return weighted.select(
        *named,
        F.when(
            ~without_population(F.col("_population")),
            weighted_rate(F.col("_cases"), F.col("_population"), F.col("_weights"), n, study.per),
        ).alias("std_rate"),
        problem.alias("problem"),
    )


def sound(rates: DataFrame) -> DataFrame:
    """The rates without ``problem``; reading the rate of a group that has one raises."""
    problem = F.col("problem")
    return rates.withColumn(
        "std_rate",
        F.when(problem.isNull(), F.col("std_rate")).otherwise(
            F.raise_error(F.concat(F.lit("cannot standardise: "), problem)).cast("double")
        ),
    ).drop("problem")


def rate_problem(cases: Column, population: Column) -> Column:
    return F.when(without_population(population), F.lit("no population in any band")).when(
        orphan_cases(cases, population), F.lit("cases in a band without population")
    )


def standardize_by_entity(df: DataFrame, standard: DataFrame, study: Study) -> DataFrame:
    return standardize(df, ["entity"], standard, study)


def repeated_bands(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups that hold a band twice although one row per group and band was promised."""
    return df.groupBy(*keys, "band").agg(F.count("*").alias("n")).filter("n > 1")


def check_standardized(rates: DataFrame) -> DataFrame:
    """Raise when any group has a problem; otherwise return the frame without that column."""
    bad = rates.filter(F.col("problem").isNotNull()).limit(1).collect()
    if bad:
        raise ValueError(f"cannot standardise: {bad[0].asDict()}")
    return rates.drop("problem")


def standard_rate(
    df: DataFrame, standard: DataFrame, study: Study, empty_band: str = "error"
) -> DataFrame:
    """One rate for a whole frame of bands, with the strict or the zero-rate contract.

    ``empty_band="error"`` wants population in every band of the standard;
    ``"zero"`` lets an empty band add nothing while its weight stays.
    """
    if empty_band not in ("error", "zero"):
        raise ValueError("empty_band must be 'error' or 'zero'")
    n = len(study.bands.labels)
    sums = df.agg(*band_sums(study.bands)).withColumn(
        "_weights", band_weights(standard, study.bands)
    )
    problem = rate_problem(F.col("_cases"), F.col("_population"))
    if empty_band == "error":
        problem = F.when(
            ~F.forall(F.col("_population"), lambda p: p > 0),
            F.lit("a band has no population"),
        )
    return sums.select(
        weighted_rate(
            F.col("_cases"), F.col("_population"), F.col("_weights"), n, study.per
        ).alias("std_rate"),
        problem.alias("problem"),
    )
