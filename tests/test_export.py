"""Export tables, and the published region tables as golden values."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from equigauge import health_study
from equigauge.config import Block
from equigauge.operators.export import (
    entity_dimension, fact_table, ranking_table, region_summary, sex_table, time_dimension,
    wide_index,
)
from equigauge.operators.scale import apply_scale
from equigauge.sinks.files import locale_columns

STUDY = health_study()

# Published region components (fixed values): region, period, standardised rate, severe share,
# lethality, index.
REGIONS = [
    ("Centro-Oeste", "2019", 62.691628410447294, 0.05732620320855615, 0.03336898395721925, 0.1303083012881809),
    ("Nordeste", "2019", 84.43417876874776, 0.05341137735503933, 0.04584324126577648, 0.16077230300043427),
    ("Norte", "2019", 108.97782739464213, 0.06787524088216401, 0.03961173363785597, 0.18124620786745693),
    ("Sudeste", "2019", 54.38117094999038, 0.08613028075276964, 0.04445764134908771, 0.16638946062438087),
    ("Sul", "2019", 64.15610786119575, 0.05829155607981913, 0.03499459353189816, 0.1346157963030065),
    ("Centro-Oeste", "2023-24", 64.99206591875965, 0.08038126306131811, 0.030684540496457517, 0.14810023196259692),
    ("Nordeste", "2023-24", 81.7639396643814, 0.08362681240503646, 0.042249207900967006, 0.18000578738488288),
    ("Norte", "2023-24", 120.17963112366498, 0.059601157928594405, 0.03357992923769701, 0.17276792148112435),
    ("Sudeste", "2023-24", 58.289133064041, 0.09816492628992629, 0.03894732800982801, 0.17140383661491282),
    ("Sul", "2023-24", 60.69388365859302, 0.06630457598656592, 0.03479219143576826, 0.1389191130033959),
]
# The published ruler: lowest value and range of each component (fixed values).
RULER = {
    "std_rate": (19.738477924438, 477.291336067198),
    "severe_frac": (0.0, 0.380220588235),
    "death_frac": (0.0, 0.222222222222),
}
# As published with decimal commas: rate, severe %, death %, index.
PUBLISHED = {
    ("Centro-Oeste", "2019"): ("62,69", "5,73", "3,34", "0,1303"),
    ("Norte", "2019"): ("108,98", "6,79", "3,96", "0,1812"),
    ("Sul", "2019"): ("64,16", "5,83", "3,5", "0,1346"),
    ("Nordeste", "2023-24"): ("81,76", "8,36", "4,22", "0,18"),
    ("Sudeste", "2023-24"): ("58,29", "9,82", "3,89", "0,1714"),
}


@pytest.fixture(scope="module")
def regions(spark):
    ruler = {c: {"low": lo, "high": lo + span, "min": lo, "max": lo + span}
             for c, (lo, span) in RULER.items()}
    df = spark.createDataFrame(
        REGIONS, "region string, period string, std_rate double, severe_frac double, "
                 "death_frac double, published double")
    return apply_scale(df, ruler, STUDY, out="region_index")


def test_published_region_index(regions):
    rows = regions.collect()
    assert len(rows) == 10
    assert all(r["region_index"] == pytest.approx(r["published"], abs=1e-11) for r in rows)


def test_published_region_summary(regions):
    got = locale_columns(region_summary(regions.drop("published")))
    rows = {(r["region"], r["period"]): (r["std_rate"], r["severe_frac"], r["death_frac"],
                                         r["region_index"]) for r in got.collect()}
    assert {k: rows[k] for k in PUBLISHED} == PUBLISHED


def test_published_sex_profile(spark):
    rows = [("Centro-Oeste", "F", 9491.0, 520.0, 332.0, 476102.0, 9491.0, 59.8654111306615,
             5.478874723422189, 3.498050784954167),
            ("Sudeste", "M", 57774.0, 7025.0, 2034.0, 3176614.0, 57774.0, 69.95692751265196,
             12.159448887042615, 3.5206148094298473)]
    df = spark.createDataFrame(
        rows, "region string, sex string, cases double, severe double, deaths double, "
              "age_sum double, age_known double, std_rate double, severe_pct double, "
              "death_pct double").withColumn("mean_age", F.lit(0.0))
    got = locale_columns(sex_table(df)).orderBy("region").collect()
    assert [tuple(r)[2:] for r in got] == [
        (9491, 520, 332, "59,87", "5,48", "3,5", "50,2"),
        (57774, 7025, 2034, "69,96", "12,16", "3,52", "55,0")]


def scored(spark):
    rows = [("a", "SP", "Sudeste", "2019", 0.10004, 10.0, 0.1, 0.05, 80.0),
            ("a", "SP", "Sudeste", "2023-24", 0.10006, 12.0, 0.2, 0.06, None),
            ("b", "CE", "Nordeste", "2019", 0.5, 20.0, 0.3, 0.07, 70.0),
            ("b", "CE", "Nordeste", "2023-24", 0.4, 18.0, 0.2, 0.06, 75.0)]
    return spark.createDataFrame(
        rows, "entity string, state string, region string, period string, index double, "
              "std_rate double, severe_frac double, death_frac double, coverage double")


def test_wide_table_and_ranking(spark):
    wide = wide_index(scored(spark), STUDY)
    row = wide.filter("entity = 'b'").first()
    assert row["change"] == pytest.approx(-0.1) and row["ranked"]
    assert wide.filter("entity = 'a'").first()["coverage_2023_24"] is None
    names = spark.createDataFrame([("a", "Alpha")], "entity string, name string")
    table = ranking_table(wide, names)
    assert table.columns[:5] == ["entity", "name", "label", "state", "region"]
    assert "ranked" not in table.columns
    rows = {r["entity"]: r for r in table.collect()}
    assert rows["a"]["label"] == "Alpha (SP)" and rows["b"]["label"] is None
    assert rows["b"]["direction"] == "Melhorou" and rows["b"]["severe_frac_2019"] == 30.0
    # The change is 0.00002: zero once rounded to four digits.
    assert rows["a"]["direction"] == "Estavel" and rows["a"]["change"] == 0.0


def test_star_schema(spark):
    rows = [("a", "SP", "Sudeste", y, "F", "<30", 2.0, 1.0, 0.0, 10.125, 3.0, 100, 55.555, 40.0, 2.0)
            for y in (2019, 2020, 2024)]
    gold = spark.createDataFrame(
        rows, "entity string, state string, region string, year int, sex string, band string, "
              "cases double, severe double, deaths double, cost double, stay_days double, "
              "population long, coverage double, age_sum double, age_known double")
    names = spark.createDataFrame([("a", "Alpha")], "entity string, name string")
    dim = entity_dimension(gold, names, gold.select("entity").limit(0), 2019).first()
    assert tuple(dim) == ("a", "Alpha", "Alpha (SP)", "SP", "Sudeste", 100, False)
    fact = fact_table(gold)
    assert "state" not in fact.columns and "region" not in fact.columns
    row = fact.first()
    assert (row["cases"], row["cost"], row["coverage"]) == (2, 10.12, 55.56)
    assert isinstance(row["cases"], int)
    blocks = (Block("2019 (pre-pandemia)", 1, (2019,)), Block("2020-21 (choque)", 2, (2020, 2021)),
              Block("2022-24 (pos)", 3, (2022, 2023, 2024)))
    times = time_dimension(gold, replace(STUDY, blocks=blocks)).orderBy("year").collect()
    assert [tuple(r) for r in times] == [
        (2019, "2019 (pre-pandemia)", 1, "2019"), (2020, "2020-21 (choque)", 2, ""),
        (2024, "2022-24 (pos)", 3, "2023-24")]
