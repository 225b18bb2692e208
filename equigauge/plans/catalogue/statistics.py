"""Ratios, quantiles, ranks, correlations and distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from equigauge.functions.numeric import ratio_of_sums
from equigauge.operators.distribution import (
    box_summary, context_correlation, context_profile, describe, histogram, null_counts,
    pearson_matrix, single_source, value_counts,
)
from equigauge.operators.measures import calibrate_cuts, index_measure_columns, measures
from equigauge.operators.profiles import with_period
from equigauge.operators.ranks import average_ranks, quantiles, spearman
from equigauge.plans import reports
from equigauge.plans.catalogue.base import big, on_layers, query, rounded


@query(on_layers("""
SELECT region, year,
       round(CAST(100000 AS DOUBLE) * sum(cases) / sum(population), 6) AS crude_rate,
       round(CAST(100 AS DOUBLE) * sum(severe) / nullif(sum(cases), 0), 6) AS severe_pct,
       round(CAST(100 AS DOUBLE) * sum(deaths) / nullif(sum(cases), 0), 6) AS death_pct,
       round(CAST(sum(age_sum) AS DOUBLE) / nullif(sum(age_known), 0), 6) AS mean_age,
       round(avg(coverage), 6) AS coverage
FROM gold GROUP BY region, year"""))
def region_ratios(d) -> DataFrame:
    """Ratios of sums, crude rate, mean of known ages, mean coverage."""
    out = d.gold_covered.groupBy("region", "year").agg(
        ratio_of_sums("cases", "population", 100_000.0).alias("crude_rate"),
        ratio_of_sums("severe", "cases", 100.0).alias("severe_pct"),
        ratio_of_sums("deaths", "cases", 100.0).alias("death_pct"),
        ratio_of_sums("age_sum", "age_known").alias("mean_age"),
        F.avg("coverage").alias("coverage"),
    )
    return rounded(out)


@query("""
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.01), 6) AS p01,
       round(quantile_cont(l_extendedprice, 0.5), 6) AS p50,
       round(quantile_cont(l_extendedprice, 0.99), 6) AS p99,
       round(quantile_cont(l_quantity, 0.25), 6) AS quantity_q1
FROM lineitem GROUP BY 1""")
def exact_quantiles(d) -> DataFrame:
    """Interpolated quantiles of every order line, one column with few and one with many ties."""
    measures_of = {"price": "l_extendedprice", "quantity": "l_quantity"}
    # Both columns under one another, so that the lines are read once.
    stacked = d.table("lineitem").select(
        "l_returnflag",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(name).alias("measure"), F.col(c).alias("value"))
                    for name, c in measures_of.items()
                ]
            )
        ),
    )
    shares = {"p01": 0.01, "p50": 0.5, "p99": 0.99, "quantity_q1": 0.25}
    found = quantiles(stacked, ["l_returnflag", "measure"], "value", shares)
    of = lambda measure, name: F.max(F.when(F.col("measure") == measure, F.col(name))).alias(name)
    return rounded(
        found.groupBy("l_returnflag").agg(
            of("price", "p01"), of("price", "p50"), of("price", "p99"), of("quantity", "quantity_q1")
        )
    )


@query("""
SELECT DISTINCT l_linestatus, l_discount, count(*) OVER same AS n,
       rank() OVER w + (count(*) OVER same - 1) / 2.0 AS rank
FROM lineitem
WINDOW w AS (PARTITION BY l_linestatus ORDER BY l_discount),
       same AS (PARTITION BY l_linestatus, l_discount)""")
def tied_ranks(d) -> DataFrame:
    """Average ranks under heavy ties."""
    return average_ranks(d.table("lineitem"), ["l_linestatus"], "l_discount").select(
        "l_linestatus", "l_discount", "n", "rank"
    )


@query("""
WITH r AS (SELECT l_shipmode, x, y,
  rank() OVER (PARTITION BY l_shipmode ORDER BY x)
    + (count(*) OVER (PARTITION BY l_shipmode, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY l_shipmode ORDER BY y)
    + (count(*) OVER (PARTITION BY l_shipmode, y) - 1) / 2.0 AS ry
  FROM (SELECT l_returnflag AS l_shipmode, l_quantity AS x, l_extendedprice AS y FROM lineitem))
SELECT l_shipmode AS l_returnflag, count(*) AS n, round(corr(rx, ry), 6) AS spearman
FROM r GROUP BY 1""")
def rank_correlation(d) -> DataFrame:
    """Spearman over every order line."""
    return rounded(
        spearman(d.table("lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    )


_INDICATORS_SQL = """, indicators AS (
SELECT entity, period, CAST(100000 AS DOUBLE) * sum(cases) / sum(population) AS crude_rate,
       CAST(sum(severe) AS DOUBLE) / nullif(sum(cases), 0) AS severe_frac,
       CAST(sum(deaths) AS DOUBLE) / nullif(sum(cases), 0) AS death_frac,
       avg(coverage) AS coverage
FROM tagged GROUP BY entity, period)
"""
_NAMES = ("crude_rate", "severe_frac", "death_frac", "coverage")
_PAIRS_SQL = " UNION ALL ".join(
    f"SELECT period, '{x}' AS x, '{y}' AS y, round(corr({x}, {y}), 6) AS r "
    "FROM indicators GROUP BY period"
    for x in _NAMES
    for y in _NAMES
)


def _indicators(d) -> DataFrame:
    cells = with_period(d.cells(d.period_years), d.study)
    return reports.period_indicators(cells).join(
        d.period_coverage, ["entity", "period"], "left"
    )


@query(on_layers(_INDICATORS_SQL + _PAIRS_SQL))
def indicator_correlations(d) -> DataFrame:
    """Correlation matrix of four indicators, per period and pairwise complete."""
    return rounded(pearson_matrix(_indicators(d), _NAMES, ["period"]))


@query(on_layers(_INDICATORS_SQL + """, r AS (
SELECT period,
       rank() OVER (PARTITION BY period ORDER BY coverage)
         + (count(*) OVER (PARTITION BY period, coverage) - 1) / 2.0 AS rx,
       rank() OVER (PARTITION BY period ORDER BY crude_rate)
         + (count(*) OVER (PARTITION BY period, crude_rate) - 1) / 2.0 AS ry
FROM (SELECT period, round(coverage, 9) AS coverage, round(crude_rate, 9) AS crude_rate
      FROM indicators) WHERE coverage IS NOT NULL AND crude_rate IS NOT NULL)
SELECT period, count(*) AS n, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY period"""))
def coverage_and_crude_rate(d) -> DataFrame:
    """Coverage against the crude rate, inside each period."""
    # Rounded first, so that equal means tie whatever order they were added up in.
    steady = rounded(_indicators(d), 9)
    return rounded(context_correlation(steady, "coverage", "crude_rate", min_rows=30))


@query(on_layers(""", r AS (
SELECT period,
       rank() OVER (PARTITION BY period ORDER BY round(coverage, 9))
         + (count(*) OVER (PARTITION BY period, round(coverage, 9)) - 1) / 2.0 AS rx,
       rank() OVER (PARTITION BY period ORDER BY round(std_rate, 9))
         + (count(*) OVER (PARTITION BY period, round(std_rate, 9)) - 1) / 2.0 AS ry
FROM ranked WHERE coverage IS NOT NULL)
SELECT period, count(*) AS n, CASE WHEN count(*) >= 30 THEN round(corr(rx, ry), 6) END AS spearman
FROM r GROUP BY period"""))
def coverage_and_standard_rate(d) -> DataFrame:
    """Coverage against the standardised rate of ranked entities, inside each period."""
    steady = d.ranked_covered.withColumns(
        {"coverage": F.round("coverage", 9), "std_rate": F.round("std_rate", 9)}
    )
    return rounded(context_correlation(steady))


@query(on_layers("""
SELECT period, region, round(quantile_cont(coverage, 0.5), 9) AS median,
       round(avg(coverage), 9) AS mean, count(coverage) AS count
FROM ranked GROUP BY period, region"""))
def coverage_profile(d) -> DataFrame:
    """Coverage of ranked entities by period and region."""
    covered = d.ranked_covered
    medians = quantiles(covered, ["period", "region"], "coverage", {"median": 0.5})
    sizes = covered.groupBy("period", "region").agg(
        F.avg("coverage").alias("mean"), F.count("coverage").alias("count")
    )
    out = sizes.join(medians, ["period", "region"], "left")
    return rounded(out.select("period", "region", "median", "mean", "count"), 9)


@query(on_layers("""
SELECT period, region, round_even(median(coverage), 1) AS median,
       round_even(avg(coverage), 1) AS mean, count(coverage) AS count
FROM ranked GROUP BY period, region"""))
def coverage_context_table(d) -> DataFrame:
    """The published form of the profile, rounded half to even."""
    return context_profile(d.ranked_covered)


@query(on_layers("""
SELECT CASE WHEN year BETWEEN 1997 AND 2000 THEN 'mixed' WHEN year < 1997 THEN 'early'
            ELSE 'late' END AS period, count(DISTINCT source) AS sources
FROM coverage GROUP BY 1 HAVING count(DISTINCT source) > 1"""))
def mixed_coverage_sources(d) -> DataFrame:
    """Year spans whose coverage comes from two methods and may not be compared."""
    spans = d.coverage.withColumn(
        "period",
        F.when(F.col("year").between(1997, 2000), "mixed")
        .when(F.col("year") < 1997, "early")
        .otherwise("late"),
    )
    return single_source(spans)


_CRUDE_SQL = """, crude AS (
SELECT entity, region, CAST(sum(cases) AS BIGINT) AS cases,
       CAST(sum(population) AS BIGINT) AS population,
       CAST(100000 AS DOUBLE) * sum(cases) / sum(population) AS crude_rate
FROM gold GROUP BY entity, region)
"""


@query(on_layers(_CRUDE_SQL + """
SELECT entity, region, cases, population, round(crude_rate, 6) AS crude_rate FROM crude"""))
def entity_crude_rates(d) -> DataFrame:
    return rounded(reports.entity_crude_rates(d.cells()))


@query(on_layers(_CRUDE_SQL + """, ends AS (
SELECT min(crude_rate) AS low, max(crude_rate) AS high FROM crude),
spots AS (SELECT least(CAST(floor((crude_rate - low) / (high - low) * 50) AS INTEGER) + 1, 50) AS bin
          FROM crude, ends),
n AS (SELECT bin, count(*) AS rows FROM spots GROUP BY bin)
SELECT CAST(b.bin AS INTEGER) AS bin, round(low + (b.bin - 1) * (high - low) / 50, 6) AS lower,
       round(low + b.bin * (high - low) / 50, 6) AS upper,
       coalesce(n.rows, 0) AS rows
FROM range(1, 51) b(bin) CROSS JOIN ends LEFT JOIN n ON n.bin = b.bin"""))
def crude_rate_histogram(d) -> DataFrame:
    """Distribution of entity rates in 50 bins, empty bins shown."""
    return rounded(histogram(reports.entity_crude_rates(d.cells()), "crude_rate", 50))


@query(on_layers(""", ry AS (
SELECT region, year, CAST(100000 AS DOUBLE) * sum(cases) / sum(population) AS rate
FROM gold GROUP BY region, year),
q AS (SELECT region, count(*) AS n, quantile_cont(rate, 0.25) AS q1,
             quantile_cont(rate, 0.5) AS median, quantile_cont(rate, 0.75) AS q3
      FROM ry GROUP BY region)
SELECT region, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(min(CASE WHEN rate >= q1 - 1.5 * (q3 - q1) AND rate <= q3 + 1.5 * (q3 - q1)
                      THEN rate END), 6) AS whisker_low,
       round(max(CASE WHEN rate >= q1 - 1.5 * (q3 - q1) AND rate <= q3 + 1.5 * (q3 - q1)
                      THEN rate END), 6) AS whisker_high,
       count_if(rate < q1 - 1.5 * (q3 - q1) OR rate > q3 + 1.5 * (q3 - q1)) AS outliers
FROM ry JOIN q USING (region) GROUP BY region, n, q1, median, q3"""))
def region_rate_boxes(d) -> DataFrame:
    """Spread of yearly rates within each region."""
    return rounded(box_summary(reports.region_year_rates(d.cells()), ["region"], "crude_rate"))


@query(on_layers("""
SELECT count(change) AS count, round(avg(change), 6) AS mean, round(stddev_samp(change), 6) AS std,
       round(min(change), 6) AS min, round(quantile_cont(change, 0.25), 6) AS q25,
       round(quantile_cont(change, 0.5), 6) AS q50, round(quantile_cont(change, 0.75), 6) AS q75,
       round(max(change), 6) AS max
FROM changes"""))
def change_description(d) -> DataFrame:
    """Count, mean, deviation and quartiles of the change of the index."""
    return rounded(describe(d.change, "change"))


@query("""
SELECT o_orderstatus, o_orderpriority, count(*) AS rows FROM orders GROUP BY 1, 2""")
def value_frequencies(d) -> DataFrame:
    return value_counts(d.table("orders"), "o_orderstatus", "o_orderpriority")


@query(on_layers("""
SELECT 'coverage' AS column, count_if(coverage IS NULL) AS nulls FROM gold
UNION ALL SELECT 'population', count_if(population IS NULL) FROM gold
UNION ALL SELECT 'cases', count_if(cases IS NULL) FROM gold"""))
def null_profile(d) -> DataFrame:
    return null_counts(d.gold_covered, ["coverage", "population", "cases"])


@query(on_layers("""
SELECT region, CAST(sum(cases) AS BIGINT) AS cases, CAST(sum(severe) AS BIGINT) AS severe,
       CAST(sum(deaths) AS BIGINT) AS deaths, round(CAST(sum(cost) AS DOUBLE), 2) AS cost,
       CAST(sum(stay_days) AS BIGINT) AS stay_days, count(DISTINCT year) AS years_in_context,
       round(CAST(sum(population) AS DOUBLE) / count(DISTINCT year), 4) AS population,
       round(CAST(sum(cases) AS DOUBLE) / count(DISTINCT year), 4) AS cases_per_year,
       round(CAST(sum(cases) AS DOUBLE) / sum(population) * 100000, 4) AS annual_rate,
       round(CAST(sum(cases) AS DOUBLE) / sum(population) * 100000, 4) AS crude_rate,
       round(CAST(sum(severe) AS DOUBLE) / sum(cases), 4) AS severe_frac,
       round(CAST(sum(deaths) AS DOUBLE) / sum(cases), 4) AS death_frac,
       round(CAST(sum(cost) AS DOUBLE) / sum(cases), 4) AS cost_per_case,
       round(sum(age_sum) / sum(age_known), 4) AS mean_age,
       round(avg(coverage), 4) AS mean_coverage
FROM gold GROUP BY region"""))
def grid_measures(d) -> DataFrame:
    """All measures of the grid by region."""
    return rounded(measures(d.gold_covered, ["region"]), 4)


@query(on_layers("""
SELECT state, CAST(sum(cases) AS BIGINT) AS cases,
       round(CAST(sum(severe) AS DOUBLE) / nullif(sum(cases), 0), 4) AS severe_frac
FROM gold WHERE year = 1996 GROUP BY state"""))
def chosen_measures(d) -> DataFrame:
    """Two measures of one year by state; other columns are never read."""
    return rounded(measures(d.cells([1996]), ["state"], ["cases", "severe_frac"]), 4)


@query(on_layers("""
SELECT region, round(avg(index_1996), 6) AS mean_index_base,
       round(avg(index_2000_01), 6) AS mean_index_current, round(avg(change), 6) AS mean_change,
       count(DISTINCT entity) AS ranked_entities
FROM changes GROUP BY region"""))
def index_measures(d) -> DataFrame:
    registry = index_measure_columns("index_1996", "index_2000_01")
    return rounded(measures(d.wide, ["region"], registry=registry))


_CUT_SQL = """, sized AS (
SELECT entity, region, sum(cases) AS total_cases, sum(population) AS population
FROM gold GROUP BY entity, region),
cuts(cut) AS (VALUES (10), (20), (30), (50))
SELECT cut{group}, count(*) AS entities, count_if(total_cases < cut) AS entities_out,
       round(100 * CAST(count_if(total_cases < cut) AS DOUBLE) / count(*), 6) AS pct_out,
       round(100 * CAST(sum(CASE WHEN total_cases >= cut THEN population END) AS DOUBLE)
             / sum(population), 6) AS pct_population_kept
FROM sized, cuts GROUP BY cut{group}"""


def _sized(d) -> DataFrame:
    return d.cells().groupBy("entity", "region").agg(
        F.sum("cases").cast("long").alias("total_cases"), big("population")
    )


@query(on_layers(_CUT_SQL.format(group="")))
def cut_calibration(d) -> DataFrame:
    """What each volume cut would remove."""
    return rounded(calibrate_cuts(_sized(d), [10, 20, 30, 50]))


@query(on_layers(_CUT_SQL.format(group=", region")))
def cut_calibration_by_region(d) -> DataFrame:
    return rounded(calibrate_cuts(_sized(d), [10, 20, 30, 50], ["region"]))
