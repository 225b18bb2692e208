"""Reports over the grid and the index."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from equigauge.config import Study
from equigauge.functions.labels import block_of_year, block_order
from equigauge.functions.numeric import money_sum, ratio, ratio_of_sums
from equigauge.operators.measures import measure_columns, measures

# Reports take the grid ("gold") or the index tables and return small tables; each is one
# aggregation, so cells of a group combine before they are shuffled.


def shown(cells: DataFrame, by: Sequence, names: Sequence[str], digits: dict[str, int]) -> DataFrame:
    """Measures of the registry by any keys, rounded half up as the reports show them."""
    table = measures(cells, by, names, report_measures())
    return table.withColumns({n: F.round(F.col(n), d) for n, d in digits.items() if n in names})


def report_measures() -> dict[str, Column]:
    """The registry, with shares in percent, which is how reports show them."""
    known = measure_columns()
    return known | {
        "population": F.sum("population").cast("long"),
        "severe_pct": ratio_of_sums("severe", "cases", 100.0),
        "death_pct": ratio_of_sums("deaths", "cases", 100.0),
    }


REPORT_DIGITS = {"cost": 2, "crude_rate": 1, "severe_pct": 2, "death_pct": 2}


def national_panorama(cells: DataFrame) -> DataFrame:
    names = ["cases", "severe", "deaths", "cost", "severe_pct", "death_pct"]
    return shown(cells, ["year"], names, REPORT_DIGITS).orderBy("year")


def region_rates(cells: DataFrame) -> DataFrame:
    return shown(cells, ["region", "year"], ["cases", "population", "crude_rate"], REPORT_DIGITS)


def region_blocks(cells: DataFrame, study: Study) -> DataFrame:
    block = block_of_year(F.col("year"), study).alias("block")
    return shown(cells, ["region", block], ["crude_rate", "severe_pct"], REPORT_DIGITS)


def sex_by_region(cells: DataFrame) -> DataFrame:
    return shown(cells, ["region", "sex"], ["cases", "severe_pct", "death_pct"], REPORT_DIGITS)


def top_severe(cells: DataFrame, study: Study, top: int = 50) -> DataFrame:
    """Entities with enough cases by their share of severe ones; ties go to the smaller code."""
    names = ["cases", "severe", "severe_pct"]
    table = shown(cells, ["entity", "state", "region"], names, REPORT_DIGITS)
    enough = table.filter(F.col("cases") >= study.min_total)
    return enough.orderBy(F.desc_nulls_last("severe_pct"), "entity").limit(top)


def national_series(gold: DataFrame) -> DataFrame:
    return gold.groupBy("year").agg(F.sum("cases").cast("long").alias("cases")).orderBy("year")


def entity_crude_rates(gold: DataFrame) -> DataFrame:
    """Crude rate of each entity over all years (person-years below the line)."""
    return gold.groupBy("entity", "region").agg(
        F.sum("cases").cast("long").alias("cases"),
        F.sum("population").cast("long").alias("population"),
        ratio_of_sums("cases", "population", 100_000.0).alias("crude_rate"),
    )


def region_year_rates(gold: DataFrame) -> DataFrame:
    return gold.groupBy("region", "year").agg(
        F.sum("cases").cast("long").alias("cases"),
        F.sum("population").cast("long").alias("population"),
        ratio_of_sums("cases", "population", 100_000.0).alias("crude_rate"),
    )


def period_indicators(cells: DataFrame) -> DataFrame:
    """Crude indicators per entity and period, from cells that carry their period."""
    return cells.groupBy("entity", "period").agg(
        ratio_of_sums("cases", "population", 100_000.0).alias("crude_rate"),
        ratio_of_sums("severe", "cases").alias("severe_frac"),
        ratio_of_sums("deaths", "cases").alias("death_frac"),
    )


def block_table(gold: DataFrame, study: Study) -> DataFrame:
    """Blocks of years side by side, as yearly averages, with the change against the first."""
    year = F.col("year")
    years = F.countDistinct("year")
    blocks = gold.groupBy(
        block_order(year, study).alias("block_order"), block_of_year(year, study).alias("block")
    ).agg(
        years.alias("years"),
        ratio(F.sum("cases"), years).alias("cases_per_year"),
        ratio(F.sum("severe"), years).alias("severe_per_year"),
        ratio_of_sums("severe", "cases", 100.0).alias("severe_pct"),
        ratio_of_sums("deaths", "cases", 100.0).alias("death_pct"),
    )
    # One row per block of the study, so the reference block is a scalar.
    first = blocks.filter(F.col("block_order") == 1).select(
        F.struct("cases_per_year", "severe_per_year")
    ).scalar()
    change = lambda c: (ratio(F.col(c), first[c]) - 1) * 100
    return blocks.withColumns(
        {
            "cases_change_pct": change("cases_per_year"),
            "severe_change_pct": change("severe_per_year"),
        }
    ).orderBy("block_order")


def growth(gold: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Change of events against change of severe outcomes and cost between two years."""
    at = lambda c, y: F.sum(F.when(F.col("year") == y, F.col(c)))
    sums = gold.filter(F.col("year").isin(first_year, last_year)).agg(
        *[
            at(c, y).cast("double").alias(f"{c}_{name}")
            for c in ("cases", "severe", "deaths")
            for name, y in (("first", first_year), ("last", last_year))
        ],
        money_sum(F.when(F.col("year") == first_year, F.col("cost"))).alias("cost_first"),
        money_sum(F.when(F.col("year") == last_year, F.col("cost"))).alias("cost_last"),
    )
    pct = lambda c: (ratio(F.col(f"{c}_last"), F.col(f"{c}_first")) - 1) * 100
    return sums.select(
        *[pct(c).alias(f"{c}_growth_pct") for c in ("cases", "severe", "deaths", "cost")],
        ratio(pct("severe"), pct("cases")).alias("severe_to_cases"),
    )


def rate_change(regions: DataFrame, study: Study) -> DataFrame:
    """Standardised rate of both periods by region and its change in percent."""
    base, current = study.periods
    wide = regions.groupBy("region").pivot("period", [base.label, current.label]).agg(
        F.min("std_rate")
    )
    b, c = F.col(f"`{base.label}`"), F.col(f"`{current.label}`")
    return wide.select(
        "region",
        b.alias("rate_base"),
        c.alias("rate_current"),
        ((ratio(c, b) - 1) * 100).alias("change_pct"),
    )


def sex_ratios(profile: DataFrame, sexes: Sequence[str] = ("F", "M")) -> DataFrame:
    """Ratios of the second sex to the first by region."""
    columns = ("cases", "severe_pct", "death_pct", "std_rate", "mean_age")
    wide = profile.groupBy("region").pivot("sex", list(sexes)).agg(
        *[F.min(c).alias(c) for c in columns]
    )
    first, second = sexes
    return wide.select(
        "region",
        *[ratio(F.col(f"{second}_{c}"), F.col(f"{first}_{c}")).alias(f"{c}_ratio") for c in columns],
    )


def change_summary(wide: DataFrame, by: Sequence[str] = ("region",)) -> DataFrame:
    """Entities that got worse and better, and the mean change."""
    return wide.groupBy(*by).agg(
        F.count("*").alias("entities"),
        F.count_if(F.col("change") > 0).alias("worse"),
        F.count_if(F.col("change") < 0).alias("better"),
        F.avg("change").alias("mean_change"),
    )


def worst_entities(wide: DataFrame, dimension: DataFrame, measure: str, top: int) -> DataFrame:
    """Highest values with name and population; the list is cut before the names are joined."""
    head = (
        wide.select("entity", F.col(measure), "change")
        .orderBy(F.desc_nulls_last(measure), F.asc("entity"))
        .limit(top)
    )
    # At most ``top`` rows.
    return dimension.select("entity", "name", "state", "population").join(
        F.broadcast(head), "entity"
    )


def most_improved(wide: DataFrame, top: int) -> DataFrame:
    return wide.select("entity", "state", "region", "change").orderBy(
        F.asc_nulls_last("change"), F.asc("entity")
    ).limit(top)


def totals(gold: DataFrame) -> DataFrame:
    """Cost and bed days by year."""
    return gold.groupBy("year").agg(
        money_sum("cost").alias("cost"),
        F.sum("stay_days").cast("long").alias("stay_days"),
        ratio(money_sum("cost"), F.sum("cases")).alias("cost_per_case"),
    )
