"""Registry of queries, and the layers once more as SQL for comparison."""

from __future__ import annotations

from typing import Callable, NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from equigauge.plans.workload import TABLES_STUDY, Layers


class Query(NamedTuple):
    build: Callable[[Layers], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def _bigint_counts(sql: str | None) -> str | None:
    """``count_if`` may be wider than 64 bits there; a filtered count is not."""
    return sql and sql.replace("count_if(", "count(*) FILTER (WHERE ")


def query(sql: str | None = None):
    """Register a function of the layers under its own name."""

    def add(build: Callable[[Layers], DataFrame]):
        if build.__name__ in REGISTRY:
            raise ValueError(f"query registered twice: {build.__name__}")
        REGISTRY[build.__name__] = Query(build, _bigint_counts(sql))
        return build

    return add


def rounded(df: DataFrame, digits: int = 6, *only: str) -> DataFrame:
    """Doubles rounded for comparison across engines."""
    names = only or [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({n: F.round(n, digits) for n in names})


def big(col: str) -> Column:
    """Long sum under the column's own name."""
    return F.sum(col).cast("long").alias(col)


_BANDS = ", ".join(f"('{b}', {i})" for i, b in enumerate(TABLES_STUDY.bands.labels))
_BAND_CASE = " ".join(
    f"WHEN age_years <= {limit} THEN '{label}'"
    for label, limit in zip(TABLES_STUDY.bands.labels, TABLES_STUDY.bands.limits)
)
_YEARS = ", ".join(f"({y})" for y in TABLES_STUDY.years)

LAYERS_SQL = f"""
WITH places AS (
  SELECT n_nationkey, n_name AS state, r_name AS region
  FROM nation JOIN region ON n_regionkey = r_regionkey),
entities AS (
  SELECT lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS code,
         lpad(CAST(c_custkey AS VARCHAR), 12, '0') || CAST(c_custkey % 10 AS VARCHAR) AS entity,
         c_name AS name, state, region, c_custkey, c_acctbal
  FROM customer JOIN places ON c_nationkey = n_nationkey),
sexes(sex, sex_ix) AS (VALUES ('F', 0), ('M', 1)),
bands(band, band_ix) AS (VALUES {_BANDS}),
years(year) AS (VALUES {_YEARS}),
census AS (
  SELECT entity, code, state, region, sex, band,
         CAST(200 + (c_custkey * 37 + sex_ix * 101 + band_ix * 59) % 400
              + floor(abs(c_acctbal) / 100) AS BIGINT) AS population
  FROM entities, sexes, bands),
raw AS (
  SELECT lpad(CAST(o_custkey AS VARCHAR), 12, '0') AS code,
         CASE WHEN l_tax > 0.075 THEN '9' WHEN l_linestatus = 'F' THEN '1'
              ELSE '3' END AS sex,
         CAST(l_quantity AS INTEGER) AS age,
         CASE p_size % 20 WHEN 0 THEN '3' WHEN 1 THEN '2' WHEN 2 THEN '5' WHEN 3 THEN '9'
              ELSE '4' END AS age_unit,
         CASE WHEN p_size <> 50 THEN ' ' || lower(substr(p_type, 1, 3)) || '0 ' END AS diagnosis,
         CASE WHEN l_returnflag = 'R'
              THEN '40805' || lpad(CAST(l_suppkey % 10000 AS VARCHAR), 4, '0')
              WHEN l_returnflag = 'A' THEN '0408010010' END AS procedure,
         CASE WHEN l_linenumber <> 7 THEN CAST(l_linenumber AS VARCHAR) END AS ident,
         CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS death,
         l_extendedprice AS cost,
         date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS stay_days,
         CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
flagged AS (
  SELECT *, coalesce(upper(substr(trim(diagnosis), 1, 3)) IN ('ECO', 'STA', 'MED', 'PRO'), false)
            AS in_cohort,
         coalesce(substr(lpad(trim(procedure), 10, '0'), 1, 6) = '040805', false) AS severe,
         coalesce(ident = '5', false) AS continuation
  FROM raw),
aged AS (
  SELECT *, CAST(CASE WHEN age_unit IN ('2', '3') THEN 0 WHEN age_unit = '4' THEN age
                      WHEN age_unit = '5' THEN age + 100 END AS DOUBLE) AS age_years
  FROM flagged WHERE in_cohort AND NOT continuation),
bronze AS (
  SELECT *, CASE WHEN age_years IS NULL THEN NULL {_BAND_CASE}
                 ELSE '{TABLES_STUDY.bands.labels[-1]}' END AS band
  FROM aged),
silver AS (
  SELECT code, year, sex, band, count(*) AS cases, sum(CAST(severe AS INTEGER)) AS severe,
         sum(death) AS deaths, sum(CAST(cost AS DECIMAL(18, 2))) AS cost,
         sum(stay_days) AS stay_days, sum(age_years) AS age_sum, count(age_years) AS age_known
  FROM bronze GROUP BY code, year, sex, band),
events AS (
  SELECT e.entity, s.year, CASE s.sex WHEN '1' THEN 'M' WHEN '3' THEN 'F' END AS sex, s.band,
         sum(cases) AS cases, sum(severe) AS severe, sum(deaths) AS deaths, sum(cost) AS cost,
         sum(stay_days) AS stay_days, sum(age_sum) AS age_sum, sum(age_known) AS age_known
  FROM silver s JOIN entities e ON s.code = e.code
  WHERE s.sex IN ('1', '3') AND s.band IS NOT NULL
  GROUP BY 1, 2, 3, 4),
coverage_monthly AS (
  SELECT lpad(CAST(o_custkey AS VARCHAR), 12, '0') AS code, CAST(year(o_orderdate) AS INTEGER)
           AS year,
         CASE WHEN year(o_orderdate) <= 1998 THEN 'cobertura_ab' ELSE 'cobertura_aps' END AS source,
         CAST(floor(o_totalprice / 5000) AS INTEGER) * 100 + o_orderkey % 100 AS hundredths
  FROM orders WHERE year(o_orderdate) <= 1998 OR o_orderkey % 20 <> 0),
coverage AS (
  SELECT entity, year, source,
         CAST(sum(hundredths) AS DOUBLE) / count(*) / 100 AS coverage
  FROM coverage_monthly JOIN entities USING (code) GROUP BY entity, year, source),
gold AS (
  SELECT g.entity, g.state, g.region, y.year, g.sex, g.band,
         CAST(coalesce(e.cases, 0) AS BIGINT) AS cases,
         CAST(coalesce(e.severe, 0) AS BIGINT) AS severe,
         CAST(coalesce(e.deaths, 0) AS BIGINT) AS deaths,
         coalesce(e.cost, 0) AS cost, CAST(coalesce(e.stay_days, 0) AS BIGINT) AS stay_days,
         g.population, v.coverage, coalesce(e.age_sum, 0) AS age_sum,
         CAST(coalesce(e.age_known, 0) AS BIGINT) AS age_known
  FROM census g CROSS JOIN years y
  LEFT JOIN events e ON e.entity = g.entity AND e.year = y.year AND e.sex = g.sex
                    AND e.band = g.band
  LEFT JOIN coverage v ON v.entity = g.entity AND v.year = y.year),
weights AS (
  SELECT band, CAST(sum(population) AS DOUBLE) / (SELECT sum(population) FROM census) AS w
  FROM census GROUP BY band),
tagged AS (
  SELECT *, CASE WHEN year = 1996 THEN '1996' ELSE '2000-01' END AS period
  FROM gold WHERE year IN (1996, 2000, 2001)),
entity_bands AS (
  SELECT entity, period, band, sum(cases) AS c, sum(population) AS p
  FROM tagged GROUP BY entity, period, band),
entity_rates AS (
  SELECT entity, period,
         sum(CASE WHEN p > 0 THEN CAST(c AS DOUBLE) / p ELSE 0 END * w) * 100000 AS std_rate
  FROM entity_bands JOIN weights USING (band) GROUP BY entity, period),
components AS (
  SELECT entity, state, region, period, CAST(sum(cases) AS BIGINT) AS cases,
         CAST(sum(severe) AS BIGINT) AS severe, CAST(sum(deaths) AS BIGINT) AS deaths,
         avg(coverage) AS coverage, min(std_rate) AS std_rate,
         CAST(sum(severe) AS DOUBLE) / nullif(sum(cases), 0) AS severe_frac,
         CAST(sum(deaths) AS DOUBLE) / nullif(sum(cases), 0) AS death_frac
  FROM tagged JOIN entity_rates USING (entity, period)
  GROUP BY entity, state, region, period),
totals AS (
  SELECT entity, CAST(sum(cases) AS BIGINT) AS total_cases, sum(population) / 7 AS population
  FROM gold GROUP BY entity),
flags AS (
  SELECT entity, total_cases, total_cases >= 20 AS passed_total,
         min(cases) >= 5 AND count(*) = 2 AS passed_period
  FROM components JOIN totals USING (entity) GROUP BY entity, total_cases),
ranked AS (
  SELECT c.* FROM components c JOIN flags USING (entity) WHERE passed_total AND passed_period),
ruler AS (
  SELECT quantile_cont(std_rate, 0.01) AS r0, quantile_cont(std_rate, 0.99) AS r1,
         quantile_cont(severe_frac, 0.01) AS s0, quantile_cont(severe_frac, 0.99) AS s1,
         quantile_cont(death_frac, 0.01) AS d0, quantile_cont(death_frac, 0.99) AS d1
  FROM ranked),
normed AS (
  SELECT ranked.*, (least(greatest(std_rate, r0), r1) - r0) / (r1 - r0) AS std_rate_norm,
         (least(greatest(severe_frac, s0), s1) - s0) / (s1 - s0) AS severe_frac_norm,
         (least(greatest(death_frac, d0), d1) - d0) / (d1 - d0) AS death_frac_norm
  FROM ranked, ruler),
scored AS (
  SELECT *, std_rate_norm / 3 + severe_frac_norm / 3 + death_frac_norm / 3 AS score FROM normed),
wide AS (
  SELECT entity, state, region,
         max(CASE WHEN period = '1996' THEN score END) AS index_1996,
         max(CASE WHEN period = '2000-01' THEN score END) AS index_2000_01
  FROM scored GROUP BY entity, state, region),
changes AS (SELECT *, index_2000_01 - index_1996 AS change FROM wide)
"""


def on_layers(select: str) -> str:
    return LAYERS_SQL + select
