"""Cohort, roll-up, grid, joins and slicing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from equigauge.config import SEX_BY_RECORD_CODE
from equigauge.functions.codes import has_padded_prefix, has_prefix, look_up
from equigauge.functions.labels import block_of_year, block_order, period_of_year
from equigauge.functions.numeric import money_sum, ratio_of_sums
from equigauge.functions.text import number_of
from equigauge.operators.grid import grid_size, population_years
from equigauge.operators.measures import (
    distinct_cells, distinct_error, distinct_of, slice_by, slice_by_dimension,
)
from equigauge.operators.profiles import with_period
from equigauge.operators.rollup import (
    duplicate_codes, expand_code, first_attributes, label_sex, merge_cells,
)
from equigauge.plans.catalogue.base import big, on_layers, query, rounded
from equigauge.session import stage_path, staged
from equigauge.sinks.files import write_partitioned
from equigauge.sources.tables import read_tree


@query(on_layers("""
SELECT year, count(*) AS rows, count_if(in_cohort) AS cohort_rows,
       count_if(severe) AS severe_rows, count_if(NOT continuation) AS kept_rows
FROM flagged GROUP BY year"""))
def cohort_flags(d) -> DataFrame:
    """Prefix membership, padded prefix, and continuations, on every record."""
    raw, study = d.raw, d.study
    return raw.groupBy("year").agg(
        F.count("*").alias("rows"),
        F.count_if(has_prefix(F.col("DIAG_PRINC"), study.cohort_prefixes)).alias("cohort_rows"),
        F.count_if(has_padded_prefix(F.col("PROC_REA"), study.severe_prefix)).alias("severe_rows"),
        F.count_if(~number_of(raw, "IDENT").eqNullSafe(F.lit(5.0))).alias("kept_rows"),
    )


@query(on_layers("""
SELECT year, month, count(*) AS cases, count_if(severe) AS severe, CAST(sum(death) AS BIGINT) AS deaths,
       CAST(sum(CAST(cost AS DECIMAL(18, 2))) AS DOUBLE) AS cost,
       CAST(sum(stay_days) AS BIGINT) AS stay_days, count(band) AS banded
FROM bronze GROUP BY year, month"""))
def cohort_layer(d) -> DataFrame:
    """The cleaned cohort layer, by month."""
    return d.bronze.groupBy("year", "month").agg(
        F.count("*").alias("cases"),
        F.count_if("severe").alias("severe"),
        F.sum("death").alias("deaths"),
        F.round(money_sum("cost"), 2).alias("cost"),
        F.sum("stay_days").alias("stay_days"),
        F.count("band").alias("banded"),
    )


@query(on_layers("""
SELECT band, count(*) AS cases, min(age_years) AS youngest, max(age_years) AS oldest,
       count(age_years) AS known
FROM bronze GROUP BY band"""))
def coded_age_bands(d) -> DataFrame:
    """Coded ages to years to bands; unknown ages keep a group without a band."""
    return d.bronze.groupBy("band").agg(
        F.count("*").alias("cases"),
        F.min("age_years").alias("youngest"),
        F.max("age_years").alias("oldest"),
        F.count("age_years").alias("known"),
    )


@query(on_layers("""
SELECT code, year, sex, band, cases, CAST(severe AS BIGINT) AS severe,
       CAST(deaths AS BIGINT) AS deaths, CAST(cost AS DOUBLE) AS cost,
       CAST(stay_days AS BIGINT) AS stay_days, age_sum, age_known FROM silver"""))
def silver_rollup(d) -> DataFrame:
    return rounded(d.silver, 2, "cost")


@query(on_layers("""
SELECT entity, year, sex, band, CAST(cases AS BIGINT) AS cases, CAST(severe AS BIGINT) AS severe,
       CAST(deaths AS BIGINT) AS deaths, CAST(cost AS DOUBLE) AS cost,
       CAST(stay_days AS BIGINT) AS stay_days, age_sum, CAST(age_known AS BIGINT) AS age_known
FROM events"""))
def merged_cells(d) -> DataFrame:
    """Mapped keys, incomplete ones dropped, cells that now coincide added up."""
    return rounded(d.events, 2, "cost")


@query(on_layers("""
SELECT year, sex, count(*) AS rows, CAST(sum(cases) AS BIGINT) AS cases FROM silver
WHERE band IS NOT NULL GROUP BY ALL"""))
def group_by_all(d) -> DataFrame:
    """Grouping by every column that is not aggregated, as SQL text."""
    return d.spark.sql(
        "SELECT year, sex, count(*) AS rows, sum(cases) AS cases FROM {silver} "
        "WHERE band IS NOT NULL GROUP BY ALL",
        silver=d.silver,
    )


@query(on_layers("""
SELECT sex, count_if(band IS NOT NULL) AS kept, count_if(band IS NULL) AS dropped
FROM bronze GROUP BY sex"""))
def null_band_filter(d) -> DataFrame:
    """Rows a null filter on the band keeps, against all rows."""
    return d.bronze.groupBy("sex").agg(
        F.count("band").alias("kept"), F.count_if(F.col("band").isNull()).alias("dropped")
    )


@query(on_layers("""
SELECT state, year, sex, band, CAST(sum(cases) AS BIGINT) AS cases,
       CAST(sum(severe) AS BIGINT) AS severe, CAST(sum(deaths) AS BIGINT) AS deaths,
       CAST(sum(cost) AS DOUBLE) AS cost, CAST(sum(population) AS BIGINT) AS population,
       count(*) AS cells, count_if(cases = 0) AS empty_cells
FROM gold GROUP BY state, year, sex, band"""))
def dense_grid_by_state(d) -> DataFrame:
    """The dense grid with zeros, added up to states."""
    return d.gold.groupBy("state", "year", "sex", "band").agg(
        big("cases"), big("severe"), big("deaths"),
        F.round(money_sum("cost"), 2).alias("cost"),
        big("population"),
        F.count("*").alias("cells"),
        F.count_if(F.col("cases") == 0).alias("empty_cells"),
    )


@query(on_layers("""
SELECT count(*) AS rows, count(DISTINCT entity) AS n_entity, count(DISTINCT year) AS n_year,
       count(DISTINCT sex) AS n_sex, count(DISTINCT band) AS n_band,
       count(DISTINCT entity) * count(DISTINCT year) * count(DISTINCT sex) * count(DISTINCT band)
         AS expected,
       count(*) = count(DISTINCT entity) * count(DISTINCT year) * count(DISTINCT sex)
         * count(DISTINCT band) AS complete
FROM gold"""))
def grid_size_check(d) -> DataFrame:
    return grid_size(d.gold, d.study)


@query(on_layers("""
SELECT region, year, count(*) AS cells, CAST(sum(population) AS BIGINT) AS population
FROM census CROSS JOIN years GROUP BY region, year"""))
def population_by_year(d) -> DataFrame:
    """Population cells repeated for each year."""
    return population_years(d.census, d.study.years).groupBy("region", "year").agg(
        F.count("*").alias("cells"), big("population")
    )


@query(on_layers("""
SELECT region, year, count(coverage) AS covered_cells, round(avg(coverage), 6) AS mean_coverage
FROM gold GROUP BY region, year"""))
def coverage_on_grid(d) -> DataFrame:
    """Coverage repeats over sex and band, so it is averaged."""
    out = d.gold_covered.groupBy("region", "year").agg(
        F.count("coverage").alias("covered_cells"), F.avg("coverage").alias("mean_coverage")
    )
    return rounded(out)


@query(on_layers("""
SELECT s.year, count(*) AS rows, count(e.entity) AS matched, count(*) - count(e.entity) AS orphans
FROM silver s LEFT JOIN (SELECT * FROM entities WHERE c_custkey % 97 <> 0) e ON s.code = e.code
GROUP BY s.year"""))
def code_expansion(d) -> DataFrame:
    """Short codes to full ones against a look-up with holes; orphans keep their rows."""
    holed = d.lookup.filter(F.col("code").cast("long") % 97 != 0)
    return expand_code(d.silver, holed).groupBy("year").agg(
        F.count("*").alias("rows"),
        F.count("entity").alias("matched"),
        F.count_if(F.col("entity").isNull()).alias("orphans"),
    )


@query(on_layers("""
SELECT code, count(*) AS n FROM
 (SELECT substr(entity, 1, 12) AS code FROM entities
  UNION ALL SELECT substr(entity, 1, 12) FROM entities WHERE c_custkey % 100 = 3)
GROUP BY code HAVING count(*) > 1"""))
def shared_short_codes(d) -> DataFrame:
    """Short codes that stand for two entities, found before they are used as keys."""
    again = d.lookup.filter(F.col("code").cast("long") % 100 == 3)
    return duplicate_codes(d.lookup.unionByName(again))


@query(on_layers("""
SELECT sex AS sex_code, CASE sex WHEN '1' THEN 'M' WHEN '3' THEN 'F' END AS sex,
       count(*) AS rows, CAST(sum(cases) AS BIGINT) AS cases
FROM silver GROUP BY 1, 2"""))
def sex_labels(d) -> DataFrame:
    """Constant look-up of codes; a code outside it has no label."""
    coded = d.silver.withColumn("sex_code", F.col("sex"))
    return label_sex(coded, SEX_BY_RECORD_CODE).groupBy("sex_code", "sex").agg(
        F.count("*").alias("rows"), big("cases")
    )


@query(on_layers("""
SELECT entity, min(state) AS state, min(region) AS region FROM gold GROUP BY entity"""))
def entity_attributes(d) -> DataFrame:
    """One known attribute value per entity."""
    return first_attributes(d.gold, "entity", ["state", "region"])


@query(on_layers("""
SELECT region, sex, year, CAST(sum(cases) AS BIGINT) AS cases,
       CAST(sum(population) AS BIGINT) AS population
FROM gold WHERE region IN ('ASIA', 'EUROPE') AND sex = 'F' AND year IN (1996, 2000)
GROUP BY ALL"""))
def sliced_grid(d) -> DataFrame:
    """Equality filters put together, as slicers do."""
    cells = slice_by(d.cells(), region=["ASIA", "EUROPE"], sex="F", year=[1996, 2000], state=None)
    return cells.groupBy("region", "sex", "year").agg(big("cases"), big("population"))


@query(on_layers("""
SELECT period, year, CAST(sum(cases) AS BIGINT) AS cases, count(*) AS cells
FROM tagged GROUP BY period, year"""))
def period_membership(d) -> DataFrame:
    """Years of both comparison periods in one pass, tagged with their period."""
    return with_period(d.gold, d.study).groupBy("period", "year").agg(
        big("cases"), F.count("*").alias("cells")
    )


@query(on_layers("""
SELECT CASE WHEN year = 1996 THEN 1 WHEN year IN (1997, 1998) THEN 2 ELSE 3 END AS block_order,
       CASE WHEN year = 1996 THEN '1996' WHEN year IN (1997, 1998) THEN '1997-98'
            ELSE '1999-01' END AS block,
       CASE WHEN year = 1996 THEN '1996' WHEN year IN (2000, 2001) THEN '2000-01' ELSE '' END
         AS period,
       count(DISTINCT year) AS years, CAST(sum(cases) AS BIGINT) AS cases
FROM gold GROUP BY 1, 2, 3"""))
def year_blocks(d) -> DataFrame:
    """Years in blocks (the last takes all other years), sorted by their order column."""
    year = F.col("year")
    return (
        d.cells().groupBy(
            block_order(year, d.study).alias("block_order"),
            block_of_year(year, d.study).alias("block"),
            period_of_year(year, d.study).alias("period"),
        )
        .agg(F.countDistinct("year").alias("years"), big("cases"))
        .orderBy("block_order")
    )


@query(on_layers("""
SELECT state, CAST(sum(cases) AS BIGINT) AS cases, CAST(sum(severe) AS BIGINT) AS severe,
       round(100 * CAST(sum(severe) AS DOUBLE) / nullif(sum(cases), 0), 6) AS severe_pct
FROM gold GROUP BY state HAVING sum(cases) >= 100"""))
def volume_floor(d) -> DataFrame:
    """A condition on an aggregate."""
    out = d.cells().groupBy("state").agg(
        big("cases"), big("severe"), ratio_of_sums("severe", "cases", 100.0).alias("severe_pct")
    )
    return rounded(out.filter(F.col("cases") >= 100))


@query(on_layers("""
SELECT t.block, e.region, CAST(sum(cases) AS BIGINT) AS cases
FROM events f JOIN entities e USING (entity)
JOIN (SELECT year, CASE WHEN year = 1996 THEN '1996' WHEN year IN (1997, 1998) THEN '1997-98'
                        ELSE '1999-01' END AS block FROM years) t USING (year)
GROUP BY t.block, e.region"""))
def star_join(d) -> DataFrame:
    """Facts against both dimensions. Facts are added up by entity and year first."""
    facts = d.events.groupBy("entity", "year").agg(big("cases"))
    years = d.spark.createDataFrame([(y,) for y in d.study.years], "year int")
    time = years.select("year", block_of_year(F.col("year"), d.study).alias("block"))
    places = d.entities.select("entity", "region")
    return facts.join(places, "entity").join(time, "year").groupBy("block", "region").agg(
        big("cases")
    )


@query(on_layers("""
SELECT e.entity, e.state FROM entities e
WHERE NOT EXISTS (SELECT 1 FROM silver s WHERE s.code = e.code)"""))
def entities_without_events(d) -> DataFrame:
    """Key difference: entities with no event in any year."""
    seen = d.bronze.select("code").distinct()
    return d.entities.join(seen, "code", "left_anti").select("entity", "state")


@query(on_layers("""
SELECT e.state, count(*) AS entities FROM entities e
WHERE EXISTS (SELECT 1 FROM silver s WHERE s.code = e.code)
GROUP BY e.state"""))
def entities_with_events(d) -> DataFrame:
    """Membership in all events as a semi join."""
    seen = d.bronze.select("code").distinct()
    return d.entities.join(seen, "code", "left_semi").groupBy("state").agg(
        F.count("*").alias("entities")
    )


@query(on_layers("SELECT DISTINCT year, sex, band FROM events"))
def distinct_keys(d) -> DataFrame:
    return d.events.select("year", "sex", "band").distinct()


@query(on_layers("""
SELECT code FROM silver WHERE year = 1996 EXCEPT SELECT code FROM silver WHERE year = 2000"""))
def key_difference(d) -> DataFrame:
    """Set minus of keys: codes seen in one year and not in another."""
    seen = lambda y: F.bool_or(F.col("year") == y)
    years = d.bronze.groupBy("code").agg(seen(1996).alias("one"), seen(2000).alias("other"))
    return years.filter(F.col("one") & ~F.col("other")).select("code")


@query(on_layers("""
SELECT region, CAST(sum(cases) AS BIGINT) AS cases, CAST(sum(severe) AS BIGINT) AS severe
FROM events f JOIN entities e USING (entity) WHERE year IN (1997, 1998) GROUP BY region"""))
def pruned_star(d) -> DataFrame:
    """Facts by year, pruned by a filter on the block of the time dimension."""
    facts, time = pruning_tables(d)
    chosen = slice_by_dimension(facts, time, "year", block="1997-98")
    by_entity = chosen.groupBy("entity").agg(big("cases"), big("severe"))
    return by_entity.join(d.entities.select("entity", "region"), "entity").groupBy("region").agg(
        big("cases"), big("severe")
    )


def pruning_tables(d) -> tuple[DataFrame, DataFrame]:
    """The facts as a tree by year, and the time dimension as a table."""
    path = stage_path(d.spark, "facts-by-year")
    write_partitioned(d.events, path, ["year"])
    years = d.spark.createDataFrame([(y,) for y in d.study.years], "year int")
    time = years.select("year", block_of_year(F.col("year"), d.study).alias("block"))
    return read_tree(d.spark, path), staged(time, "time")


@query(on_layers("""
SELECT region, count(DISTINCT entity) AS entities, true AS within_bound
FROM events f JOIN entities e USING (entity) WHERE sex = 'F' AND year >= 1997 GROUP BY region"""))
def distinct_sketches(d) -> DataFrame:
    """Entities with events of a slice: exact, and united from sketches of its cells."""
    events = d.events.join(d.entities.select("entity", "region"), "entity")
    cells = distinct_cells(events, ["region", "sex", "year"], "entity")
    chosen = (F.col("sex") == "F") & (F.col("year") >= 1997)
    estimated = distinct_of(cells.filter(chosen), ["region"])
    exact = events.filter(chosen).groupBy("region").agg(F.countDistinct("entity").alias("entities"))
    error = F.abs(F.col("estimate") - F.col("entities"))
    return exact.join(estimated, "region").select(
        "region", "entities", (error <= distinct_error() * F.col("entities")).alias("within_bound")
    )


@query(on_layers("""
SELECT region, year, count(coverage) AS covered_cells, round(avg(coverage), 6) AS mean_coverage
FROM gold GROUP BY region, year"""))
def colocated_coverage(d) -> DataFrame:
    """Coverage over the grid from layers that are laid out by entity: no shuffle before the sums."""
    out = d.gold_colocated.groupBy("region", "year").agg(
        F.count("coverage").alias("covered_cells"), F.avg("coverage").alias("mean_coverage")
    )
    return rounded(out)
