"""Validation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from equigauge.operators.rollup import expand_code
from equigauge.operators.validate import (
    loss_account, orphan_denominators, orphan_key_share, population_contract, range_violations,
    reconcile,
)
from equigauge.plans.catalogue.base import big, on_layers, query, rounded
from equigauge.session import staged


@query(on_layers("""
SELECT entity, year, sex, band, cases FROM gold
WHERE cases > 0 AND (CAST(right(entity, 2) AS INTEGER) % 10 = 3
      OR (band = '8-14' AND state = 'NATION_1'))"""))
def orphan_denominator_rows(d) -> DataFrame:
    """Cells with cases whose population is missing or zero."""
    population = (
        F.when(F.right("entity", F.lit(2)).cast("int") % 10 == 3, F.lit(None))
        .when((F.col("band") == "8-14") & (F.col("state") == "NATION_1"), F.lit(0))
        .otherwise(F.col("population"))
    )
    cells = d.gold.withColumn("population", population.cast("long"))
    return orphan_denominators(cells).select("entity", "year", "sex", "band", "cases")


@query(on_layers("""
SELECT 1 AS position, 'std_rate' AS measure, count_if(std_rate < 0) AS below,
       CAST(0 AS BIGINT) AS above FROM components
UNION ALL SELECT 2, 'severe_frac', count_if(severe_frac < 0), count_if(severe_frac > 0.5)
FROM components
UNION ALL SELECT 3, 'coverage', count_if(coverage < 10), count_if(coverage > 90)
FROM components"""))
def range_check(d) -> DataFrame:
    """Values outside their limits, per measure, against tighter limits than usual."""
    limits = {
        "std_rate": (0.0, None), "severe_frac": (0.0, 0.5), "coverage": (10.0, 90.0),
        "absent": (0.0, 1.0),
    }
    return range_violations(d.components_dense, limits)


@query(on_layers(""", ours AS (
SELECT region, year, CAST(sum(cases) AS BIGINT) AS n FROM gold
WHERE NOT (region = 'ASIA' AND year = 1999) GROUP BY region, year),
others AS (
SELECT region, year, CAST(sum(cases) + CASE WHEN year = 1997 THEN floor(sum(cases) / 20) ELSE 0 END
                          AS BIGINT) AS n
FROM gold WHERE NOT (region = 'AFRICA' AND year = 1998) GROUP BY region, year)
SELECT region, year, a.n AS cases_ours, b.n AS cases_external, a.n - b.n AS difference,
       round(abs(a.n - b.n) / CAST(nullif(b.n, 0) AS DOUBLE), 6) AS relative_error,
       coalesce(abs(a.n - b.n) / CAST(nullif(b.n, 0) AS DOUBLE) <= 0.02, false) AS passed
FROM ours a FULL OUTER JOIN others b USING (region, year)"""))
def external_reconciliation(d) -> DataFrame:
    """Totals against another source; keys missing on either side stay and fail."""
    # Both sides of the comparison start from these few rows.
    sums = staged(d.cells().groupBy("region", "year").agg(big("cases")), "region-years")
    at = lambda r, y: (F.col("region") == r) & (F.col("year") == y)
    more = F.when(F.col("year") == 1997, F.floor(F.col("cases") / 20)).otherwise(
        F.lit(0)
    )
    external = sums.filter(~at("AFRICA", 1998)).withColumn("cases", F.col("cases") + more)
    return rounded(reconcile(sums.filter(~at("ASIA", 1999)), external, ["region", "year"]))


@query(on_layers(""", m AS (
SELECT s.code, e.entity FROM silver s
LEFT JOIN (SELECT * FROM entities WHERE c_custkey % 97 <> 0) e ON s.code = e.code)
SELECT count(*) AS rows, count_if(entity IS NULL) AS orphans,
       round(count_if(entity IS NULL) / CAST(count(*) AS DOUBLE), 6) AS share,
       count_if(entity IS NULL) / CAST(count(*) AS DOUBLE) < 0.01 AS passed
FROM m"""))
def orphan_keys(d) -> DataFrame:
    """Share of rows whose code has no entity, against the one percent gate."""
    holed = d.lookup.filter(F.col("code").cast("long") % 97 != 0)
    return rounded(orphan_key_share(expand_code(d.silver, holed)))


@query(on_layers(""", m AS (
SELECT s.*, e.entity FROM silver s
LEFT JOIN (SELECT * FROM entities WHERE c_custkey % 97 <> 0) e ON s.code = e.code)
SELECT CAST(sum(cases) AS BIGINT) AS cases, count_if(entity IS NULL) AS rows_without_entity,
       count_if(sex NOT IN ('1', '3')) AS rows_with_other_sex,
       CAST(sum(CASE WHEN entity IS NULL THEN cases ELSE 0 END) AS BIGINT) AS cases_without_entity,
       CAST(sum(CASE WHEN sex NOT IN ('1', '3') THEN cases ELSE 0 END) AS BIGINT)
         AS cases_without_sex,
       CAST(sum(CASE WHEN band IS NULL THEN cases ELSE 0 END) AS BIGINT) AS cases_without_band,
       CAST(sum(CASE WHEN entity IS NULL OR sex NOT IN ('1', '3') OR band IS NULL
                THEN cases ELSE 0 END) AS BIGINT) AS cases_outside_grid
FROM m"""))
def losses_to_grid(d) -> DataFrame:
    """Events that find no grid cell, by reason."""
    holed = d.lookup.filter(F.col("code").cast("long") % 97 != 0)
    return loss_account(expand_code(d.silver, holed), ["1", "3"])


@query(on_layers(""", p AS (
SELECT CASE WHEN c.band = '15-21' AND c.state = 'NATION_2' THEN 'other' ELSE c.band END AS band,
       CASE WHEN c.state = 'NATION_4' THEN -population ELSE population END AS population,
       entity, sex, region FROM census c)
SELECT 'key_length' AS rule, count_if(length(entity) <> 13) AS violations FROM p
UNION ALL SELECT 'unknown_band', count_if(band = 'other') FROM p
UNION ALL SELECT 'missing_band', 7 - count(DISTINCT CASE WHEN band <> 'other' THEN band END) FROM p
UNION ALL SELECT 'unknown_sex', count_if(sex NOT IN ('F', 'M')) FROM p
UNION ALL SELECT 'missing_sex', 2 - count(DISTINCT sex) FROM p
UNION ALL SELECT 'negative', count_if(population < 0) FROM p
UNION ALL SELECT 'regions', CASE WHEN count(DISTINCT region) = 5 THEN 0 ELSE 1 END FROM p
UNION ALL SELECT 'total', CASE WHEN abs(sum(population) - 100000000) <= 500000 THEN 0 ELSE 1 END
FROM p"""))
def population_rules(d) -> DataFrame:
    """The population contract on a table with some rows spoiled."""
    spoiled = d.census.withColumns(
        {
            "band": F.when(
                (F.col("band") == "15-21") & (F.col("state") == "NATION_2"), "other"
            ).otherwise(F.col("band")),
            "population": F.when(F.col("state") == "NATION_4", -F.col("population")).otherwise(
                F.col("population")
            ),
        }
    )
    return population_contract(spoiled, d.study.bands, d.study.sexes, 13, 5, 100_000_000)
