"""Wide index table, star schema and presentation tables."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, functions as F

from equigauge.config import Study
from equigauge.functions.labels import (
    block_of_year, block_order, change_label, name_with_state, period_of_year,
)
from equigauge.functions.numeric import half_even, ratio, whole

WIDE_MEASURES = ("index", "std_rate", "severe_frac", "death_frac", "coverage")


def wide_index(
    scored: DataFrame, study: Study, measures: Sequence[str] = WIDE_MEASURES
) -> DataFrame:
    """One row per entity, each measure once per period, the change, and the ranking mark.

    Index and change come out of the same grouping: no join back.
    """
    periods = study.periods
    base, current = periods
    columns = []
    for m in measures:
        for p in periods:
            columns.append(
                F.avg(F.when(F.col("period") == p.label, F.col(m))).alias(f"{m}_{p.suffix}")
            )
    wide = scored.groupBy("entity", "state", "region").agg(*columns)
    return wide.withColumn(
        "change", F.col(f"index_{current.suffix}") - F.col(f"index_{base.suffix}")
    ).withColumn("ranked", F.lit(True))


def entity_dimension(
    gold: DataFrame, names: DataFrame, ranked: DataFrame, year: int
) -> DataFrame:
    """Entities with name, label, one year's population and whether they are ranked.

    Names and ranking keys grow with the entities, so the planner chooses the join by size.
    """
    people = (
        gold.filter(F.col("year") == year)
        .groupBy("entity", "state", "region")
        .agg(F.sum("population").cast("long").alias("population"))
    )
    marks = ranked.select("entity").distinct().withColumn("_ranked", F.lit(True))
    return (
        people.join(names.select("entity", "name"), "entity", "left")
        .join(marks, "entity", "left")
        .select(
            "entity",
            "name",
            name_with_state(F.col("name"), F.col("state")).alias("label"),
            "state",
            "region",
            "population",
            F.col("_ranked").isNotNull().alias("ranked"),
        )
    )


def time_dimension(gold: DataFrame, study: Study) -> DataFrame:
    """One row per year: block, its order, and the comparison period."""
    year = F.col("year")
    return gold.select("year").distinct().select(
        "year",
        block_of_year(year, study).alias("block"),
        block_order(year, study).alias("block_order"),
        period_of_year(year, study).alias("period"),
    )


COUNTS = ("cases", "severe", "deaths", "stay_days", "age_sum", "age_known")


def fact_table(gold: DataFrame) -> DataFrame:
    """Grid cells without attributes of the entity; counts as integers, amounts rounded."""
    return gold.drop("state", "region").withColumns(
        {
            **{c: whole(F.col(c)) for c in COUNTS},
            "cost": half_even(F.col("cost"), 2),
            "coverage": half_even(F.col("coverage"), 2),
        }
    )


def ranking_table(wide: DataFrame, names: DataFrame) -> DataFrame:
    """Wide index rounded for reading: fractions as percent, and the sign of the change."""
    rounded = {}
    for c in wide.columns:
        if c.startswith(("index_", "change")):
            rounded[c] = half_even(F.col(c), 4)
        elif c.startswith(("severe_frac", "death_frac")):
            rounded[c] = half_even(F.lit(100.0) * F.col(c), 2)
        elif c.startswith(("std_rate", "coverage")):
            rounded[c] = half_even(F.col(c), 2)
    table = wide.withColumns(rounded).join(names.select("entity", "name"), "entity", "left")
    head = ["entity", "name", "label", "state", "region"]
    rest = [c for c in wide.columns if c not in (*head, "ranked")]
    return table.select(
        "entity",
        "name",
        name_with_state(F.col("name"), F.col("state")).alias("label"),
        "state",
        "region",
        *rest,
        change_label(F.col("change")).alias("direction"),
    )


def region_summary(regions: DataFrame) -> DataFrame:
    """Region index rounded for reading; fractions become percent."""
    rounded = {c: half_even(F.lit(100.0) * F.col(c), 2) for c in ("severe_frac", "death_frac")}
    for c in regions.columns:
        if c == "region_index" or c.endswith("_norm"):
            rounded[c] = half_even(F.col(c), 4)
    rounded |= {c: half_even(F.col(c), 2) for c in ("std_rate", "coverage")}
    rounded |= {c: whole(F.col(c)) for c in ("cases", "severe", "deaths")}
    return regions.withColumns({c: v for c, v in rounded.items() if c in regions.columns})


def sex_table(profile: DataFrame) -> DataFrame:
    """Region by sex profile rounded for reading, with the mean age instead of its parts."""
    return profile.withColumns(
        {
            "mean_age": half_even(ratio(F.col("age_sum"), F.col("age_known")), 1),
            **{c: half_even(F.col(c), 2) for c in ("std_rate", "severe_pct", "death_pct")},
            **{c: whole(F.col(c)) for c in ("cases", "severe", "deaths")},
        }
    ).drop("age_sum", "age_known")
