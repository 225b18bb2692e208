"""Responses of the census and coverage services, and reference totals in crosstab text."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from equigauge.config import CENSUS_GROUPS_BY_BAND, SEX_BY_CENSUS_CODE, STATE_BY_CODE
from equigauge.functions.codes import look_up, region_of_state, state_of_code
from equigauge.functions.numeric import half_even
from equigauge.functions.text import lenient_double, locale_double, strip, year_of_period

# Shape of a census response (field names are fixed values of the service).
CENSUS_SCHEMA = (
    "array<struct<resultados: array<struct<"
    "classificacoes: array<struct<categoria: map<string, string>>>, "
    "series: array<struct<localidade: struct<id: string>, serie: map<string, string>>>>>>>"
)


def flatten_census(documents: DataFrame, column: str = "json") -> DataFrame:
    """JSON text to (entity, sex_code, group_id, value) rows."""
    first_key = lambda m: F.try_element_at(F.map_keys(m), F.lit(1))
    first_value = lambda m: F.try_element_at(F.map_values(m), F.lit(1))
    results = documents.select(
        F.explode(F.from_json(F.col(column), CENSUS_SCHEMA)).alias("variable")
    ).select(F.explode("variable.resultados").alias("result"))
    category = lambda i: F.col("result.classificacoes")[i]["categoria"]
    return results.select(
        first_key(category(0)).alias("sex_code"),
        first_key(category(1)).try_cast("long").alias("group_id"),
        F.explode("result.series").alias("series"),
    ).select(
        F.col("series.localidade.id").alias("entity"),
        "sex_code",
        "group_id",
        lenient_double(first_value(F.col("series.serie"))).alias("value"),
    )


def read_census(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """Census responses in files, one in each, or one on each line."""
    return flatten_census(spark.read.text(path, wholetext=whole_files), "value")


def add_areas(population: DataFrame) -> DataFrame:
    """State and region of each entity, from the first digits of its code."""
    state = state_of_code(F.col("entity"))
    return population.withColumn("state", state).withColumn(
        "region", region_of_state(F.col("state"))
    )


def regroup_bands(
    flat: DataFrame,
    groups_by_band: Mapping[str, Sequence[int]] = CENSUS_GROUPS_BY_BAND,
    sexes: Mapping[str, str] = SEX_BY_CENSUS_CODE,
) -> DataFrame:
    """Fine age groups to study bands, summed. Missing values count as zero.

    Unknown groups and sexes stay as null keys, where the population contract finds them.
    """
    band_by_group = {g: band for band, groups in groups_by_band.items() for g in groups}
    return (
        flat.select(
            "entity",
            look_up(F.col("sex_code"), sexes).alias("sex"),
            look_up(F.col("group_id").cast("int"), band_by_group).alias("band"),
            F.coalesce(F.col("value"), F.lit(0.0)).cast("long").alias("population"),
        )
        .groupBy("entity", "sex", "band")
        .agg(F.sum("population").alias("population"))
    )


@dataclass(frozen=True)
class CoverageSeries:
    """One coverage series: which field holds its value, and the tag of its rows."""

    value_field: str
    source: str


# The two published series (fixed values).
COVERAGE_SERIES = (
    CoverageSeries("pcCoberturaAb", "cobertura_ab"),
    CoverageSeries("qtCobertura", "cobertura_aps"),
)
COVERAGE_SCHEMA = "coMunicipioIbge string, nuComp string, pcCoberturaAb string, qtCobertura string"


def coverage_rows(records: DataFrame, series: CoverageSeries) -> DataFrame:
    """Records of one series in the common layout; rows without a value are dropped."""
    return records.select(
        strip(F.col("coMunicipioIbge")).alias("code"),
        year_of_period(F.col("nuComp")).alias("year"),
        locale_double(F.col(series.value_field)).alias("coverage"),
        F.lit(series.source).alias("source"),
    ).dropna(subset=["coverage"])


def all_coverage(
    records: DataFrame, series: Sequence[CoverageSeries] = COVERAGE_SERIES
) -> DataFrame:
    """Records of all series in the common layout, in one pass over them."""
    values = F.array(
        *[
            F.struct(
                locale_double(F.col(s.value_field)).alias("coverage"), F.lit(s.source).alias("source")
            )
            for s in series
        ]
    )
    return records.select(
        strip(F.col("coMunicipioIbge")).alias("code"),
        year_of_period(F.col("nuComp")).alias("year"),
        F.inline(values),
    ).dropna(subset=["coverage"])


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    """Coverage records in JSON files (an array or a line each), in the common layout."""
    return all_coverage(spark.read.schema(COVERAGE_SCHEMA).json(path))


def read_crosstab(
    spark: SparkSession, path: str, states: Mapping[int, str] = STATE_BY_CODE
) -> DataFrame:
    """Crosstab files, each with its own line of years."""
    return crosstab_to_long(spark.read.text(path, wholetext=True), states)


def union_coverage(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def annual_coverage(monthly: DataFrame, digits: int | None = 2) -> DataFrame:
    """Mean of the monthly values per code, year and source, rounded half to even."""
    mean = F.avg("coverage")
    return monthly.groupBy("code", "year", "source").agg(
        (mean if digits is None else half_even(mean, digits)).alias("coverage")
    )


def crosstab_to_long(
    files: DataFrame, states: Mapping[int, str] = STATE_BY_CODE, column: str = "value"
) -> DataFrame:
    """Quoted ``;`` crosstab (one file per row) to (state, year, cases).

    The first quoted line names the years; rows without a two-digit area code (totals) are
    dropped; dots are thousands marks and a dash is zero.
    """
    unquote = lambda line: F.transform(
        F.split(line, ";"), lambda field: F.btrim(field, F.lit('"'))
    )
    lines = F.filter(
        F.split(F.col(column), r"\r?\n"), lambda line: F.startswith(line, F.lit('"'))
    )
    tables = files.select(F.transform(lines, unquote).alias("rows")).filter(F.size("rows") > 1)
    head = F.try_element_at(F.col("rows"), F.lit(1))
    years = F.filter(
        F.slice(head, F.lit(2), F.size(head)), lambda y: F.regexp_like(y, F.lit(r"^\d+$"))
    )
    body = tables.select(
        years.alias("years"),
        F.explode(F.slice(F.col("rows"), F.lit(2), F.size("rows"))).alias("row"),
    )
    area = F.regexp_extract(F.col("row")[0], r"^\s*(\d{2})\s", 1).try_cast("int")
    long = body.select(
        look_up(area, states).alias("state"),
        "row",
        F.posexplode("years").alias("position", "year"),
    ).filter(F.col("state").isNotNull())
    cell = F.try_element_at(F.col("row"), (F.col("position") + 2))
    return long.select(
        "state",
        F.col("year").cast("int").alias("year"),
        _count(cell).alias("cases"),
    )


def _count(cell: Column) -> Column:
    digits = F.replace(F.replace(cell, F.lit("."), F.lit("")), F.lit("-"), F.lit("0"))
    text = strip(digits)
    return F.when(F.length(text) > 0, text.cast("long")).otherwise(F.lit(0).cast("long"))
