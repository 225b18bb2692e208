"""Standardised rates, eligibility, the scale, the index, its change, and its robustness."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from equigauge.functions.numeric import ratio
from equigauge.operators.eligibility import (
    exclusion_funnel, rank_by_events, rank_eligibility, volume_flag,
)
from equigauge.operators.scale import (
    apply_scale, composite_index, fit_scale, index_change, min_max, winsorize,
)
from equigauge.operators.sensitivity import shared_top, top_entities, weight_sensitivity
from equigauge.operators.standardize import (
    sound, repeated_bands, standard_rate, standardize, standardize_by_entity,
)
from equigauge.plans.catalogue.base import big, on_layers, query, rounded
from equigauge.session import staged


@query(on_layers("""
SELECT band, CAST(sum(population) AS BIGINT) AS population FROM census GROUP BY band"""))
def standard_structure(d) -> DataFrame:
    """Reference population by band."""
    return d.standard


def _rates_sql(keys: str, where: str = "true") -> str:
    return f""", bands_of AS (
SELECT {keys}, band, sum(cases) AS c, sum(population) AS p FROM gold WHERE {where}
GROUP BY {keys}, band)
SELECT {keys}, round(sum(CASE WHEN p > 0 THEN CAST(c AS DOUBLE) / p ELSE 0 END * w) * 100000, 6)
         AS std_rate, CAST(sum(c) AS BIGINT) AS cases
FROM bands_of JOIN weights USING (band) GROUP BY {keys}"""


@query(on_layers(""", b AS (
SELECT band, sum(cases) AS c, sum(population) AS p FROM gold GROUP BY band)
SELECT round(sum(CAST(c AS DOUBLE) / p * w) * 100000, 6) AS std_rate,
       CAST(NULL AS VARCHAR) AS problem
FROM b JOIN weights USING (band)"""))
def national_standard_rate(d) -> DataFrame:
    """One strict rate for the whole grid."""
    return rounded(standard_rate(d.cells(), d.standard, d.study, empty_band="error"))


@query(on_layers(""", b AS (
SELECT band, sum(cases) AS c, sum(population) AS p FROM gold
WHERE band NOT IN ('<8', '43+') GROUP BY band)
SELECT round(sum(CAST(c AS DOUBLE) / p * w) * 100000, 6) AS std_rate,
       CAST(NULL AS VARCHAR) AS problem
FROM b JOIN weights USING (band)"""))
def rate_with_missing_bands(d) -> DataFrame:
    """Two bands are absent: they add nothing, and the others do not take over their weight."""
    cells = d.cells().filter(~F.col("band").isin("<8", "43+"))
    return rounded(standard_rate(cells, d.standard, d.study, empty_band="zero"))


@query(on_layers(_rates_sql("state, year")))
def state_year_standard_rates(d) -> DataFrame:
    out = standardize(d.cells(), ["state", "year"], d.standard, d.study, extra=[big("cases")])
    return rounded(out.drop("problem"))


@query(on_layers(_rates_sql("region, sex", "year IN (2000, 2001)")))
def region_sex_standard_rates(d) -> DataFrame:
    cells = d.cells(d.study.current.years)
    out = standardize(cells, ["region", "sex"], d.standard, d.study, extra=[big("cases")])
    return rounded(out.drop("problem"))


@query(on_layers(_rates_sql("entity").replace(", CAST(sum(c) AS BIGINT) AS cases", "")))
def entity_standard_rates(d) -> DataFrame:
    return rounded(standardize_by_entity(d.cells(), d.standard, d.study).drop("problem"))


@query(on_layers(""", holed AS (
SELECT state, band, sum(cases) AS c,
       sum(CASE WHEN state = 'NATION_3' THEN 0
                WHEN state = 'NATION_5' AND band = '8-14' THEN 0 ELSE population END) AS p
FROM gold GROUP BY state, band)
SELECT state, CASE WHEN max(p) <= 0 THEN 'no population in any band'
                   WHEN count_if(c > 0 AND p <= 0) > 0
                   THEN 'cases in a band without population' END AS problem
FROM holed GROUP BY state"""))
def standardization_problems(d) -> DataFrame:
    """Groups that cannot be standardised, with the reason, before anything is raised."""
    gone = (F.col("state") == "NATION_3") | (
        (F.col("state") == "NATION_5") & (F.col("band") == "8-14")
    )
    cells = d.cells().withColumn(
        "population", F.when(gone, F.lit(0)).otherwise(F.col("population"))
    )
    return standardize(cells, ["state"], d.standard, d.study).select("state", "problem")


@query(on_layers("""
SELECT state, band, count(*) AS n FROM (
  SELECT state, band, sex FROM census GROUP BY 1, 2, 3) GROUP BY state, band HAVING count(*) > 1"""))
def repeated_band_rows(d) -> DataFrame:
    """Groups with more than one row per band, which one-row-per-band input must not have."""
    rows = d.census.groupBy("state", "sex", "band").agg(big("population"))
    return repeated_bands(rows, ["state"])


@query(on_layers("""
SELECT entity, state, region, period, cases, severe, deaths, round(coverage, 6) AS coverage,
       round(std_rate, 6) AS std_rate, round(severe_frac, 6) AS severe_frac,
       round(death_frac, 6) AS death_frac
FROM components"""))
def entity_components_from_grid(d) -> DataFrame:
    """Index components of all entities, from the dense grid."""
    return rounded(d.components_dense.drop("problem"))


@query(on_layers("""
SELECT entity, state, region, period, c.cases, severe, deaths, f.total_cases, passed_total,
       passed_period, passed_total AND passed_period AS ranked,
       round(std_rate, 6) AS std_rate, round(severe_frac, 6) AS severe_frac,
       round(death_frac, 6) AS death_frac
FROM components c JOIN flags f USING (entity)"""))
def entity_components_from_records(d) -> DataFrame:
    """The same components without the grid, with the ranking flags."""
    return rounded(d.components.drop("problem"))


@query(on_layers("""
SELECT entity, period, cases, cases >= 20 AS ranked FROM components"""))
def volume_flags(d) -> DataFrame:
    return volume_flag(d.components.select("entity", "period", "cases"), d.study.min_total)


def _flagged(d) -> DataFrame:
    """Eligibility by the general operator, on a frame where some entities lack a period."""
    return rank_by_events(d.events, d.study)


_FLAGGED_SQL = """, stacked AS (
SELECT entity, CASE WHEN year = 1996 THEN '1996' ELSE '2000-01' END AS period,
       CAST(sum(cases) AS BIGINT) AS cases
FROM events WHERE year IN (1996, 2000, 2001) GROUP BY 1, 2),
event_totals AS (SELECT entity, CAST(sum(cases) AS BIGINT) AS total_cases FROM events GROUP BY 1),
event_flags AS (
SELECT entity, total_cases, total_cases >= 20 AS passed_total,
       count(*) = 2 AND min(cases) >= 5 AS passed_period, count(*) AS n_periods
FROM stacked JOIN event_totals USING (entity) GROUP BY entity, total_cases)
"""


@query(on_layers(_FLAGGED_SQL + """
SELECT entity, period, cases, total_cases, passed_total, passed_period,
       passed_total AND passed_period AS ranked
FROM stacked JOIN event_flags USING (entity)"""))
def ranking_eligibility(d) -> DataFrame:
    """Both ranking rules, with their flags."""
    return _flagged(d)


@query(on_layers(_FLAGGED_SQL + """, reasons AS (
SELECT CASE WHEN NOT passed_total THEN 1 WHEN NOT passed_period THEN 2
            WHEN n_periods < 2 THEN 3 ELSE 4 END AS step FROM event_flags)
SELECT s.step, s.reason, count(r.step) AS entities, (SELECT count(*) FROM reasons) AS total
FROM (VALUES (1, 'below_total'), (2, 'below_period'), (3, 'incomplete'), (4, 'ranked'))
     s(step, reason)
LEFT JOIN reasons r ON r.step = s.step GROUP BY s.step, s.reason"""))
def ranking_funnel(d) -> DataFrame:
    """Entities by the first rule they fail; the parts add up to all entities."""
    return exclusion_funnel(_flagged(d))


@query("""
WITH q AS (SELECT quantile_cont(l_extendedprice, 0.01) AS lo,
                  quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem)
SELECT l_returnflag, round(sum(least(greatest(l_extendedprice, lo), hi)), 2) AS clipped_sum,
       count_if(l_extendedprice < lo OR l_extendedprice > hi) AS clipped_rows
FROM lineitem, q GROUP BY 1""")
def winsorized_prices(d) -> DataFrame:
    """Every price clipped at the first and last percentile."""
    lines = d.table("lineitem").select(
        "l_returnflag", "l_extendedprice", F.col("l_extendedprice").alias("clipped")
    )
    return winsorize(lines, "clipped").groupBy("l_returnflag").agg(
        F.round(F.sum("clipped"), 2).alias("clipped_sum"),
        F.count_if(F.col("clipped") != F.col("l_extendedprice")).alias("clipped_rows"),
    )


@query("""
SELECT l_returnflag,
       round(avg((l_extendedprice - lo) / (hi - lo)), 6) AS mean_norm
FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
GROUP BY 1""")
def min_max_prices(d) -> DataFrame:
    return rounded(
        min_max(d.table("lineitem"), "l_extendedprice", "norm")
        .groupBy("l_returnflag")
        .agg(F.avg("norm").alias("mean_norm"))
    )


@query(on_layers("""
SELECT 'std_rate' AS component, round(r0, 6) AS low, round(r1, 6) AS high,
       round(r0, 6) AS min, round(r1, 6) AS max FROM ruler
UNION ALL SELECT 'severe_frac', round(s0, 6), round(s1, 6), round(s0, 6), round(s1, 6) FROM ruler
UNION ALL SELECT 'death_frac', round(d0, 6), round(d1, 6), round(d0, 6), round(d1, 6)
FROM ruler"""))
def fitted_scale(d) -> DataFrame:
    """The ruler of the ranked entities, both periods together."""
    return rounded(fit_scale(d.ranked, d.study))


_INDEX_SQL = """
SELECT entity, state, region, period, cases, round(std_rate, 6) AS std_rate,
       round(std_rate_norm, 6) AS std_rate_norm, round(severe_frac_norm, 6) AS severe_frac_norm,
       round(death_frac_norm, 6) AS death_frac_norm, round(score, 6) AS "index"
FROM scored"""
_INDEX_COLUMNS = (
    "entity", "state", "region", "period", "cases", "std_rate", "std_rate_norm",
    "severe_frac_norm", "death_frac_norm", "index",
)


@query(on_layers(_INDEX_SQL))
def entity_index(d) -> DataFrame:
    """The composite index of every ranked entity in both periods."""
    return rounded(d.index.select(*_INDEX_COLUMNS))


@query(on_layers(_INDEX_SQL))
def entity_index_from_grid(d) -> DataFrame:
    """The index by fit and apply in one call, on grid components cut by the general rules."""
    components = staged(sound(d.components_dense), "components")
    totals = d.events.groupBy("entity").agg(F.sum("cases").cast("long").alias("total_cases"))
    ranked = rank_eligibility(components, totals, d.study).filter("ranked")
    return rounded(composite_index(ranked, d.study).select(*_INDEX_COLUMNS))


@query(on_layers("""
SELECT entity, round(index_1996, 6) AS index_1996, round(index_2000_01, 6) AS index_2000_01,
       round(change, 6) AS change FROM changes"""))
def index_changes(d) -> DataFrame:
    """Index of both periods and its change; positive is worse."""
    return rounded(d.change)


@query(on_layers("""
SELECT entity, round(index_1996, 6) AS index_1996, round(index_2000_01, 6) AS index_2000_01,
       round(change, 6) AS change FROM changes"""))
def colocated_changes(d) -> DataFrame:
    """The same from components that are laid out by entity: both periods meet without a shuffle."""
    scored = apply_scale(d.ranked_colocated, d.ruler, d.study)
    return rounded(index_change(scored, d.study))


@query(on_layers(""", by_region AS (
SELECT region, period, band, sum(cases) AS c, sum(population) AS p
FROM tagged GROUP BY region, period, band),
region_rates AS (
SELECT region, period, sum(CAST(c AS DOUBLE) / p * w) * 100000 AS std_rate
FROM by_region JOIN weights USING (band) GROUP BY region, period),
region_parts AS (
SELECT region, period, CAST(sum(cases) AS BIGINT) AS cases, avg(coverage) AS coverage,
       min(std_rate) AS std_rate, CAST(sum(severe) AS DOUBLE) / sum(cases) AS severe_frac,
       CAST(sum(deaths) AS DOUBLE) / sum(cases) AS death_frac
FROM tagged JOIN region_rates USING (region, period) GROUP BY region, period)
SELECT region, period, cases, round(coverage, 6) AS coverage, round(std_rate, 6) AS std_rate,
       round(severe_frac, 6) AS severe_frac, round(death_frac, 6) AS death_frac,
       round(((least(greatest(std_rate, r0), r1) - r0) / (r1 - r0)
            + (least(greatest(severe_frac, s0), s1) - s0) / (s1 - s0)
            + (least(greatest(death_frac, d0), d1) - d0) / (d1 - d0)) / 3, 6) AS region_index
FROM region_parts, ruler"""))
def region_index(d) -> DataFrame:
    """Regions over all entities, measured on the ranked entities' ruler."""
    return rounded(
        d.regions.select(
            "region", "period", "cases", "coverage", "std_rate", "severe_frac", "death_frac",
            "region_index",
        )
    )


@query(on_layers(""", cells AS (SELECT * FROM gold WHERE year IN (2000, 2001)),
b AS (SELECT region, sex, band, sum(cases) AS c, sum(population) AS p FROM cells
      GROUP BY region, sex, band),
r AS (SELECT region, sex, sum(CAST(c AS DOUBLE) / p * w) * 100000 AS std_rate
      FROM b JOIN weights USING (band) GROUP BY region, sex)
SELECT region, sex, CAST(sum(cases) AS BIGINT) AS cases, CAST(sum(severe) AS BIGINT) AS severe,
       CAST(sum(deaths) AS BIGINT) AS deaths, CAST(sum(age_sum) AS DOUBLE) AS age_sum,
       CAST(sum(age_known) AS BIGINT) AS age_known, round(min(std_rate), 6) AS std_rate,
       round(CAST(100 AS DOUBLE) * sum(severe) / sum(cases), 6) AS severe_pct,
       round(CAST(100 AS DOUBLE) * sum(deaths) / sum(cases), 6) AS death_pct,
       round(sum(age_sum) / sum(age_known), 6) AS mean_age
FROM cells JOIN r USING (region, sex) GROUP BY region, sex"""))
def region_sex_profile(d) -> DataFrame:
    return rounded(d.sexes)


@query(on_layers(""", cells AS (SELECT * FROM gold WHERE year IN (2000, 2001)),
b AS (SELECT region, sex, band, sum(cases) AS c, sum(population) AS p FROM cells
      GROUP BY region, sex, band),
r AS (SELECT region, sex, sum(CAST(c AS DOUBLE) / p * w) * 100000 AS std_rate
      FROM b JOIN weights USING (band) GROUP BY region, sex)
SELECT region, sex, CAST(sum(cases) AS BIGINT) AS cases, CAST(sum(severe) AS BIGINT) AS severe,
       CAST(sum(deaths) AS BIGINT) AS deaths, CAST(sum(age_sum) AS DOUBLE) AS age_sum,
       CAST(sum(age_known) AS BIGINT) AS age_known, round(min(std_rate), 6) AS std_rate,
       round(CAST(100 AS DOUBLE) * sum(severe) / sum(cases), 6) AS severe_pct,
       round(CAST(100 AS DOUBLE) * sum(deaths) / sum(cases), 6) AS death_pct,
       round(sum(age_sum) / sum(age_known), 6) AS mean_age
FROM cells JOIN r USING (region, sex) GROUP BY region, sex"""))
def shared_sex_profile(d) -> DataFrame:
    """The same from the pass that the index and the regions share."""
    now = sound(d.shared_components(["region", "sex"])).filter(F.col("period") == d.study.current.label)
    return rounded(
        now.select(
            "region", "sex", "cases", "severe", "deaths", "age_sum", "age_known", "std_rate",
            (F.col("severe_frac") * 100).alias("severe_pct"), (F.col("death_frac") * 100).alias("death_pct"),
            ratio(F.col("age_sum"), F.col("age_known")).alias("mean_age"),
        )
    )


@query(on_layers(""", now AS (SELECT * FROM ranked WHERE period = '2000-01'),
q AS (
SELECT quantile_cont(std_rate, 0.01) AS r0, quantile_cont(std_rate, 0.99) AS r1,
       quantile_cont(severe_frac, 0.01) AS s0, quantile_cont(severe_frac, 0.99) AS s1,
       quantile_cont(death_frac, 0.01) AS d0, quantile_cont(death_frac, 0.99) AS d1 FROM now),
norms AS (
SELECT entity, (least(greatest(std_rate, r0), r1) - r0) / (r1 - r0) AS a,
       (least(greatest(severe_frac, s0), s1) - s0) / (s1 - s0) AS b,
       (least(greatest(death_frac, d0), d1) - d0) / (d1 - d0) AS c FROM now, q),
schemes(scheme, wa, wb, wc) AS (VALUES ('equal', 1/3, 1/3, 1/3), ('outcome', 0.20, 0.45, 0.35),
  ('severity', 0.20, 0.35, 0.45), ('access', 0.50, 0.25, 0.25)),
scores AS (
SELECT scheme, entity, round(a * CAST(wa AS DOUBLE) + b * CAST(wb AS DOUBLE)
         + c * CAST(wc AS DOUBLE), 9) AS score,
       round((a + b + c) / 3, 9) AS reference FROM norms, schemes),
ranks AS (
SELECT scheme, entity,
  rank() OVER (PARTITION BY scheme ORDER BY score)
    + (count(*) OVER (PARTITION BY scheme, score) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY scheme ORDER BY reference)
    + (count(*) OVER (PARTITION BY scheme, reference) - 1) / 2.0 AS ry,
  row_number() OVER (PARTITION BY scheme ORDER BY score DESC, entity) <= 50 AS top_score,
  row_number() OVER (PARTITION BY scheme ORDER BY reference DESC, entity) <= 50 AS top_reference
FROM scores)
SELECT scheme, count(*) AS n, round(corr(rx, ry), 6) AS spearman,
       count_if(top_score AND top_reference) AS overlap,
       corr(rx, ry) > 0.9 AND count_if(top_score AND top_reference) / 50.0 > 0.8 AS stable
FROM ranks GROUP BY scheme"""))
def weight_scheme_sensitivity(d) -> DataFrame:
    """Agreement of other weightings with equal weights: rank correlation and top-list overlap."""
    return rounded(weight_sensitivity(d.ranked, d.study, top=50))


@query(on_layers("""
SELECT entity, round(score, 6) AS "index" FROM scored WHERE period = '2000-01'
ORDER BY score DESC, entity LIMIT 100"""))
def top_index(d) -> DataFrame:
    """The hundred highest values of the current period."""
    now = d.index.filter(F.col("period") == d.study.current.label)
    return rounded(top_entities(now.select("entity", "index"), "index", 100))


@query(on_layers(""", tops AS (
SELECT period, entity, row_number() OVER (PARTITION BY period ORDER BY score DESC, entity) AS k
FROM scored)
SELECT count(*) AS shared FROM tops a JOIN tops b USING (entity)
WHERE a.period = '1996' AND b.period = '2000-01' AND a.k <= 50 AND b.k <= 50"""))
def shared_top_list(d) -> DataFrame:
    """Entities in the top fifty of both periods."""
    of = lambda p: d.index.filter(F.col("period") == p.label)
    return shared_top(of(d.study.base), of(d.study.current), "index", 50)
