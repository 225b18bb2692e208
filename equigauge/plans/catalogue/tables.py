"""Export tables and reports."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from equigauge.config import Block
from equigauge.operators.export import (
    entity_dimension, fact_table, ranking_table, region_summary, sex_table, time_dimension,
)
from equigauge.operators.validate import export_checks
from equigauge.plans import reports
from equigauge.plans.catalogue.base import big, on_layers, query, rounded
from equigauge.session import stage_path, swept
from equigauge.sinks.files import write_locale_csv
from equigauge.sources.tables import read_locale_csv


@query(on_layers("""
SELECT entity, state, region,
  round(max(CASE WHEN period = '1996' THEN score END), 6) AS index_1996,
  round(max(CASE WHEN period = '2000-01' THEN score END), 6) AS index_2000_01,
  round(max(CASE WHEN period = '1996' THEN std_rate END), 6) AS std_rate_1996,
  round(max(CASE WHEN period = '2000-01' THEN std_rate END), 6) AS std_rate_2000_01,
  round(max(CASE WHEN period = '1996' THEN severe_frac END), 6) AS severe_frac_1996,
  round(max(CASE WHEN period = '2000-01' THEN severe_frac END), 6) AS severe_frac_2000_01,
  round(max(CASE WHEN period = '1996' THEN death_frac END), 6) AS death_frac_1996,
  round(max(CASE WHEN period = '2000-01' THEN death_frac END), 6) AS death_frac_2000_01,
  round(max(CASE WHEN period = '1996' THEN coverage END), 6) AS coverage_1996,
  round(max(CASE WHEN period = '2000-01' THEN coverage END), 6) AS coverage_2000_01,
  round(max(CASE WHEN period = '2000-01' THEN score END)
      - max(CASE WHEN period = '1996' THEN score END), 6) AS change,
  true AS ranked
FROM scored GROUP BY entity, state, region"""))
def wide_index_table(d) -> DataFrame:
    """One row per ranked entity: five measures in both periods, and the change."""
    return rounded(d.wide)


@query(on_layers("""
SELECT e.entity, e.name, e.name || ' (' || e.state || ')' AS label, e.state, e.region,
       CAST(c.population AS BIGINT) AS population,
       e.entity IN (SELECT entity FROM ranked) AS ranked
FROM entities e
JOIN (SELECT entity, sum(population) AS population FROM census GROUP BY 1) c USING (entity)"""))
def entity_dimension_table(d) -> DataFrame:
    """Entities with name, one year's population, and the ranking mark."""
    names = d.entities.select("entity", "name")
    return entity_dimension(d.grid([1996]), names, d.components.filter("ranked"), 1996)


@query(on_layers("""
SELECT year, CASE WHEN year = 1996 THEN '1996 (before)' WHEN year IN (1997, 1998)
         THEN '1997-98 (shock)' ELSE '1999-01 (after)' END AS block,
       CASE WHEN year = 1996 THEN 1 WHEN year IN (1997, 1998) THEN 2 ELSE 3 END AS block_order,
       CASE WHEN year = 1996 THEN '1996' WHEN year IN (2000, 2001) THEN '2000-01' ELSE '' END
         AS period
FROM (SELECT DISTINCT year FROM gold)"""))
def time_dimension_table(d) -> DataFrame:
    """Years with the block labels of the report."""
    blocks = (
        Block("1996 (before)", 1, (1996,)),
        Block("1997-98 (shock)", 2, (1997, 1998)),
        Block("1999-01 (after)", 3, None),
    )
    return time_dimension(d.gold, replace(d.study, blocks=blocks))


@query(on_layers("""
SELECT year, sex, band, CAST(sum(cases) AS BIGINT) AS cases, CAST(sum(severe) AS BIGINT) AS severe,
       CAST(sum(deaths) AS BIGINT) AS deaths, CAST(sum(cost) AS DOUBLE) AS cost,
       CAST(sum(stay_days) AS BIGINT) AS stay_days, CAST(sum(population) AS BIGINT) AS population,
       CAST(sum(age_sum) AS BIGINT) AS age_sum, CAST(sum(age_known) AS BIGINT) AS age_known,
       count(*) AS facts, count(coverage) AS covered
FROM gold GROUP BY year, sex, band"""))
def fact_table_totals(d) -> DataFrame:
    """The fact table, added up by its time and person keys."""
    facts = fact_table(d.gold_covered)
    out = facts.groupBy("year", "sex", "band").agg(
        *[big(c) for c in ("cases", "severe", "deaths", "stay_days", "population", "age_sum",
                           "age_known")],
        F.sum("cost").alias("cost"),
        F.count("*").alias("facts"),
        F.count("coverage").alias("covered"),
    )
    return rounded(out, 2, "cost")


# Half to even in whole numbers: means of a few hundredths often lie exactly between two.
_HUNDREDTHS = "(CAST(round({x} * 10000000, 0) AS BIGINT))"
_COVERAGE = (
    f"({_HUNDREDTHS} // 100000 + CASE WHEN {_HUNDREDTHS} % 100000 > 50000 OR "
    f"({_HUNDREDTHS} % 100000 = 50000 AND {_HUNDREDTHS} // 100000 % 2 = 1) THEN 1 ELSE 0 END) / 100.0::DOUBLE"
)


def _rounded_max(column: str, period: str, scale: str, digits: int) -> str:
    x = f"max(CASE WHEN period = '{period}' THEN {column} END)"
    return _COVERAGE.format(x=x) if column == "coverage" else f"round_even({scale}{x}, {digits})"


_WIDE = ", ".join(
    f"{_rounded_max(column, period, scale, digits)} AS {name}_{suffix}"
    for column, name, scale, digits in (
        ("score", "index", "", 4),
        ("std_rate", "std_rate", "", 2),
        ("severe_frac", "severe_frac", "100.0::DOUBLE * ", 2),
        ("death_frac", "death_frac", "100.0::DOUBLE * ", 2),
        ("coverage", "coverage", "", 2),
    )
    for period, suffix in (("1996", "1996"), ("2000-01", "2000_01"))
)
_RANKING = f""", presented AS (
SELECT entity, {_WIDE},
       round_even(max(CASE WHEN period = '2000-01' THEN score END)
                - max(CASE WHEN period = '1996' THEN score END), 4) AS change
FROM scored GROUP BY entity)
SELECT p.*, name, name || ' (' || state || ')' AS label, state, region,
       CASE WHEN change > 0 THEN 'Piorou' WHEN change < 0 THEN 'Melhorou' ELSE 'Estavel' END
         AS direction
FROM presented p JOIN entities USING (entity)"""


@query(on_layers("""
SELECT entity, name, name || ' (' || w.state || ')' AS label, w.state, w.region,
       CASE WHEN round_even(change, 4) > 0 THEN 'Piorou' WHEN round_even(change, 4) < 0
            THEN 'Melhorou' ELSE 'Estavel' END AS direction,
       round_even(index_1996, 4) AS index_1996, round_even(index_2000_01, 4) AS index_2000_01
FROM changes w JOIN entities e USING (entity)"""))
def ranking_presentation(d) -> DataFrame:
    """The ranking as published: names, rounded values, and the direction of the change."""
    table = ranking_table(d.wide, d.entities.select("entity", "name"))
    return table.select(
        "entity", "name", "label", "state", "region", "direction", "index_1996", "index_2000_01"
    )


@query(on_layers(_RANKING))
def ranking_presentation_full(d) -> DataFrame:
    """All rounded columns of the published ranking, half to even."""
    means = {c: F.round(c, 7) for c in d.wide.columns if c.startswith("coverage")}
    return ranking_table(d.wide.withColumns(means), d.entities.select("entity", "name"))


def _rates_by(keys: str, years: str) -> str:
    return f"""
parts AS (
  SELECT {keys}, band, sum(cases) AS c, sum(population) AS p FROM gold WHERE {years}
  GROUP BY {keys}, band),
part_rates AS (
  SELECT {keys}, sum(CASE WHEN p > 0 THEN CAST(c AS DOUBLE) / p ELSE 0 END * w) * 100000 AS std_rate
  FROM parts JOIN weights USING (band) GROUP BY {keys})"""


_NORM = lambda c, k: f"(least(greatest({c}, {k}0), {k}1) - {k}0) / ({k}1 - {k}0)"
_REGIONS = f""", parts AS (
  SELECT region, period, band, sum(cases) AS c, sum(population) AS p FROM tagged
  GROUP BY region, period, band),
part_rates AS (
  SELECT region, period,
         sum(CASE WHEN p > 0 THEN CAST(c AS DOUBLE) / p ELSE 0 END * w) * 100000 AS std_rate
  FROM parts JOIN weights USING (band) GROUP BY region, period),
sums AS (
  SELECT region, period, CAST(sum(cases) AS BIGINT) AS cases, CAST(sum(severe) AS BIGINT) AS severe,
         CAST(sum(deaths) AS BIGINT) AS deaths, avg(coverage) AS coverage,
         CAST(sum(severe) AS DOUBLE) / nullif(sum(cases), 0) AS severe_frac,
         CAST(sum(deaths) AS DOUBLE) / nullif(sum(cases), 0) AS death_frac
  FROM tagged GROUP BY region, period),
n AS (
  SELECT *, {_NORM("std_rate", "r")} AS rn, {_NORM("severe_frac", "s")} AS sn,
         {_NORM("death_frac", "d")} AS dn
  FROM sums JOIN part_rates USING (region, period), ruler)
SELECT region, period, cases, severe, deaths, round_even(coverage, 2) AS coverage,
       round_even(std_rate, 2) AS std_rate, round_even(100.0::DOUBLE * severe_frac, 2) AS severe_frac,
       round_even(100.0::DOUBLE * death_frac, 2) AS death_frac, round_even(rn, 4) AS std_rate_norm,
       round_even(sn, 4) AS severe_frac_norm, round_even(dn, 4) AS death_frac_norm,
       round_even(rn / 3 + sn / 3 + dn / 3, 4) AS region_index
FROM n"""


@query(on_layers(_REGIONS))
def region_presentation(d) -> DataFrame:
    """Region index as published, half to even."""
    return region_summary(d.regions)


@query(on_layers("," + _rates_by("region, sex", "year IN (2000, 2001)") + """
SELECT region, sex, CAST(sum(cases) AS BIGINT) AS cases, CAST(sum(severe) AS BIGINT) AS severe,
       CAST(sum(deaths) AS BIGINT) AS deaths, round_even(min(std_rate), 2) AS std_rate,
       round_even(100.0::DOUBLE * sum(severe) / nullif(sum(cases), 0), 2) AS severe_pct,
       round_even(100.0::DOUBLE * sum(deaths) / nullif(sum(cases), 0), 2) AS death_pct,
       round_even(sum(age_sum)::DOUBLE / nullif(sum(age_known), 0), 1) AS mean_age
FROM gold JOIN part_rates USING (region, sex) WHERE year IN (2000, 2001) GROUP BY region, sex"""))
def sex_presentation(d) -> DataFrame:
    """Region by sex profile as published, half to even."""
    return sex_table(d.sexes)


@query(on_layers("""
SELECT CAST(sum(cases) AS BIGINT) AS source_total, CAST(sum(cases) AS BIGINT) AS exported_total,
       (SELECT count_if(c_custkey % 500 = 499) FROM entities) AS unnamed_entities,
       (SELECT count_if(c_custkey % 500 = 499) FROM entities) = 0 AS passed
FROM gold"""))
def export_round_trip(d) -> DataFrame:
    """The exported facts re-read from locale CSV against their source, and unnamed entities.

    The facts are a hundred rows of text an entity: compressed, and the grid is not shuffled.
    """
    d = d.with_silver_staged()
    facts = fact_table(d.gold_by_entity).drop("coverage")
    path = stage_path(d.spark, "facts")
    with swept(d.spark):
        write_locale_csv(facts, path, compression="gzip")
    numbers = {c: "bigint" for c in ("cases", "severe", "deaths", "population")}
    back = read_locale_csv(d.spark, path, facts.columns, numbers)
    names = d.entities.filter(F.col("c_custkey") % 500 != 499).select("entity", "name")
    entities = d.entities.select("entity").join(names, "entity", "left")
    return export_checks(d.cells(), back, entities)


@query(on_layers("SELECT year, CAST(sum(cases) AS BIGINT) AS cases FROM gold GROUP BY year"))
def national_series(d) -> DataFrame:
    return reports.national_series(d.cells())


@query(on_layers(""", b AS (
SELECT CASE WHEN year = 1996 THEN 1 WHEN year IN (1997, 1998) THEN 2 ELSE 3 END AS block_order,
       CASE WHEN year = 1996 THEN '1996' WHEN year IN (1997, 1998) THEN '1997-98'
            ELSE '1999-01' END AS block,
       count(DISTINCT year) AS years,
       CAST(sum(cases) AS DOUBLE) / count(DISTINCT year) AS cases_per_year,
       CAST(sum(severe) AS DOUBLE) / count(DISTINCT year) AS severe_per_year,
       CAST(100 AS DOUBLE) * sum(severe) / sum(cases) AS severe_pct,
       CAST(100 AS DOUBLE) * sum(deaths) / sum(cases) AS death_pct
FROM gold GROUP BY 1, 2)
SELECT b.block_order, b.block, b.years, round(b.cases_per_year, 6) AS cases_per_year,
       round(b.severe_per_year, 6) AS severe_per_year, round(b.severe_pct, 6) AS severe_pct,
       round(b.death_pct, 6) AS death_pct,
       round((b.cases_per_year / f.cases_per_year - 1) * 100, 6) AS cases_change_pct,
       round((b.severe_per_year / f.severe_per_year - 1) * 100, 6) AS severe_change_pct
FROM b, b f WHERE f.block_order = 1"""))
def block_comparison(d) -> DataFrame:
    """Blocks as yearly averages, with their change against the first."""
    return rounded(reports.block_table(d.cells(), d.study))


@query(on_layers(""", g AS (
SELECT sum(CASE WHEN year = 1996 THEN cases END) AS c0,
       sum(CASE WHEN year = 2000 THEN cases END) AS c1,
       sum(CASE WHEN year = 1996 THEN severe END) AS s0,
       sum(CASE WHEN year = 2000 THEN severe END) AS s1,
       sum(CASE WHEN year = 1996 THEN deaths END) AS d0,
       sum(CASE WHEN year = 2000 THEN deaths END) AS d1,
       CAST(sum(CASE WHEN year = 1996 THEN cost END) AS DOUBLE) AS m0,
       CAST(sum(CASE WHEN year = 2000 THEN cost END) AS DOUBLE) AS m1 FROM gold)
SELECT round((CAST(c1 AS DOUBLE) / c0 - 1) * 100, 5) AS cases_growth_pct,
       round((CAST(s1 AS DOUBLE) / s0 - 1) * 100, 5) AS severe_growth_pct,
       round((CAST(d1 AS DOUBLE) / d0 - 1) * 100, 5) AS deaths_growth_pct,
       round((m1 / m0 - 1) * 100, 5) AS cost_growth_pct,
       round((CAST(s1 AS DOUBLE) / s0 - 1) / (CAST(c1 AS DOUBLE) / c0 - 1), 5) AS severe_to_cases
FROM g"""))
def growth_of_severity(d) -> DataFrame:
    return rounded(reports.growth(d.cells([1996, 2000]), 1996, 2000), 5)


@query(on_layers(""", b AS (
SELECT region, period, band, sum(cases) AS c, sum(population) AS p FROM tagged GROUP BY 1, 2, 3),
r AS (SELECT region, period, sum(CAST(c AS DOUBLE) / p * w) * 100000 AS std_rate
      FROM b JOIN weights USING (band) GROUP BY region, period)
SELECT x.region, round(x.std_rate, 6) AS rate_base, round(y.std_rate, 6) AS rate_current,
       round((y.std_rate / x.std_rate - 1) * 100, 6) AS change_pct
FROM r x JOIN r y USING (region) WHERE x.period = '1996' AND y.period = '2000-01'"""))
def region_rate_changes(d) -> DataFrame:
    return rounded(reports.rate_change(d.regions, d.study))


@query(on_layers(""", cells AS (SELECT * FROM gold WHERE year IN (2000, 2001)),
b AS (SELECT region, sex, band, sum(cases) AS c, sum(population) AS p FROM cells
      GROUP BY region, sex, band),
r AS (SELECT region, sex, sum(CAST(c AS DOUBLE) / p * w) * 100000 AS std_rate
      FROM b JOIN weights USING (band) GROUP BY region, sex),
s AS (SELECT region, sex, CAST(sum(cases) AS DOUBLE) AS cases,
       CAST(100 AS DOUBLE) * sum(severe) / sum(cases) AS severe_pct,
       CAST(100 AS DOUBLE) * sum(deaths) / sum(cases) AS death_pct, min(std_rate) AS std_rate,
       sum(age_sum) / sum(age_known) AS mean_age
  FROM cells JOIN r USING (region, sex) GROUP BY region, sex)
SELECT f.region, round(m.cases / f.cases, 6) AS cases_ratio,
       round(m.severe_pct / f.severe_pct, 6) AS severe_pct_ratio,
       round(m.death_pct / f.death_pct, 6) AS death_pct_ratio,
       round(m.std_rate / f.std_rate, 6) AS std_rate_ratio,
       round(m.mean_age / f.mean_age, 6) AS mean_age_ratio
FROM s f JOIN s m USING (region) WHERE f.sex = 'F' AND m.sex = 'M'"""))
def sex_ratios_by_region(d) -> DataFrame:
    return rounded(reports.sex_ratios(d.sexes))


@query(on_layers("""
SELECT region, count(*) AS entities, count_if(change > 0) AS worse, count_if(change < 0) AS better,
       round(avg(change), 6) AS mean_change
FROM changes GROUP BY region"""))
def change_by_region(d) -> DataFrame:
    """How many entities got worse and better, by region."""
    return rounded(reports.change_summary(d.wide))


@query(on_layers("""
SELECT e.entity, e.name, e.state, CAST(c.population AS BIGINT) AS population,
       round(w.index_2000_01, 6) AS index_2000_01, round(w.change, 6) AS change
FROM (SELECT * FROM changes ORDER BY index_2000_01 DESC NULLS LAST, entity LIMIT 10) w
JOIN entities e USING (entity)
JOIN (SELECT entity, sum(population) AS population FROM census GROUP BY 1) c USING (entity)"""))
def worst_entities(d) -> DataFrame:
    """The ten highest current values, with name and population."""
    names = d.entities.select("entity", "name")
    dimension = entity_dimension(d.grid([1996]), names, d.ranked, 1996)
    return rounded(reports.worst_entities(d.wide, dimension, "index_2000_01", 10))


@query(on_layers("""
SELECT entity, state, region, round(change, 6) AS change FROM changes
ORDER BY change, entity LIMIT 20"""))
def most_improved_entities(d) -> DataFrame:
    return rounded(reports.most_improved(d.wide, 20))


@query(on_layers("""
SELECT year, CAST(sum(cost) AS DOUBLE) AS cost, CAST(sum(stay_days) AS BIGINT) AS stay_days,
       round(CAST(sum(cost) AS DOUBLE) / sum(cases), 4) AS cost_per_case
FROM gold GROUP BY year"""))
def cost_and_bed_days(d) -> DataFrame:
    return rounded(rounded(reports.totals(d.cells()), 4, "cost_per_case"), 2, "cost")
