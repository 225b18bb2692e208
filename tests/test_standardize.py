from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from equigauge import Bands, health_study
from equigauge.operators.standardize import (
    sound,
    check_standardized, repeated_bands, standard_rate, standardize, standardize_by_entity,
)

STUDY = replace(health_study(), bands=Bands(("<30", "60-69", "80+"), (29, 79)))
EXPECTED = 140 / 6000 * 1e5


@pytest.fixture
def standard(spark):
    return spark.createDataFrame(
        [("<30", 4200), ("60-69", 800), ("80+", 1000)], "band string, population long")


def cells(spark, rows):
    return spark.createDataFrame(rows, "entity string, band string, cases long, population long")


def rates(df, standard, keys=("entity",)):
    out = check_standardized(standardize(df, list(keys), standard, STUDY))
    return {tuple(r[k] for k in keys): r["std_rate"] for r in out.collect()}


def test_missing_band_keeps_its_weight(spark, standard):
    df = cells(spark, [("a", "60-69", 5, 100), ("a", "80+", 10, 100)])
    assert rates(df, standard)[("a",)] == pytest.approx(EXPECTED)


def test_missing_band_equals_band_without_cases(spark, standard):
    df = cells(spark, [
        ("a", "60-69", 5, 100), ("a", "80+", 10, 100),
        ("b", "60-69", 5, 100), ("b", "80+", 10, 100), ("b", "<30", 0, 999),
        ("c", "60-69", 5, 100), ("c", "80+", 10, 100), ("c", "<30", 0, 0)])
    got = rates(df, standard)
    assert got[("a",)] == got[("b",)] == got[("c",)]


def test_foreign_band_is_ignored(spark, standard):
    df = cells(spark, [("a", "60-69", 5, 100), ("a", "80+", 10, 100), ("a", "other", 99, 1)])
    assert rates(df, standard)[("a",)] == pytest.approx(EXPECTED)


def test_group_without_population_is_an_error(spark, standard):
    for rows in ([("a", "<30", 0, 0)], [("a", "other", 3, 10)], [("a", "<30", 0, None)]):
        with pytest.raises(ValueError, match="no population"):
            rates(cells(spark, rows), standard)


def test_cases_without_population_are_an_error(spark, standard):
    df = cells(spark, [("a", "<30", 3, 0), ("a", "80+", 1, 10)])
    with pytest.raises(ValueError, match="without population"):
        rates(df, standard)


def test_rows_without_key_are_dropped(spark, standard):
    df = cells(spark, [(None, "<30", 3, 10), ("a", "80+", 1, 10)])
    assert set(rates(df, standard)) == {("a",)}


def test_two_keys_and_entity_form(spark, standard):
    df = cells(spark, [("a", "80+", 1, 10), ("b", "80+", 2, 10)]).withColumn("sex", F.lit("F"))
    assert rates(df, standard, ("entity", "sex"))[("b", "F")] == pytest.approx(2 / 10 / 6 * 1e5)
    one = standardize_by_entity(df, standard, STUDY)
    assert {r["entity"] for r in one.collect()} == {"a", "b"}


def test_rate_does_not_depend_on_size(spark, standard):
    df = cells(spark, [("small", "<30", 1, 10), ("small", "80+", 2, 20),
                       ("large", "<30", 1000, 10000), ("large", "80+", 2000, 20000)])
    got = rates(df, standard)
    assert got[("small",)] == pytest.approx(got[("large",)])


def test_scale_of_the_standard_does_not_matter(spark, standard):
    df = cells(spark, [("a", "<30", 1, 10), ("a", "80+", 2, 20)])
    bigger = standard.withColumn("population", F.col("population") * 1000)
    assert rates(df, standard) == rates(df, bigger)


def test_strict_and_zero_contracts(spark, standard):
    full = cells(spark, [("a", b, 5, 500) for b in STUDY.bands.labels])
    assert standard_rate(full, standard, STUDY).first()["std_rate"] == pytest.approx(1000.0)
    holed = full.filter("band <> '<30'")
    with pytest.raises(ValueError, match="band"):
        check_standardized(standard_rate(holed, standard, STUDY))
    zero = check_standardized(standard_rate(holed, standard, STUDY, "zero")).first()["std_rate"]
    assert zero == pytest.approx(300.0)
    with pytest.raises(ValueError, match="empty_band"):
        standard_rate(full, standard, STUDY, "other")


def test_repeated_bands_are_found(spark):
    df = cells(spark, [("a", "<30", 1, 1), ("a", "<30", 2, 1), ("b", "<30", 1, 1)])
    assert [(r["entity"], r["n"]) for r in repeated_bands(df, ["entity"]).collect()] == [("a", 2)]


def test_random_groups_match_plain_arithmetic(spark, standard):
    rng = np.random.default_rng(5)
    rows, expected = [], {}
    weights = np.array([4200, 800, 1000]) / 6000
    for e in range(60):
        pop = rng.integers(0, 50, 3)
        pop[rng.integers(3)] += 1
        cases = np.where(pop > 0, rng.integers(0, 20, 3), 0)
        rows += [(f"e{e}", b, int(c), int(p)) for b, c, p in zip(STUDY.bands.labels, cases, pop)]
        rate = np.divide(cases, pop, out=np.zeros(3), where=pop > 0)
        expected[(f"e{e}",)] = (rate * weights).sum() * 1e5
    got = rates(cells(spark, rows), standard)
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(expected[k]) for k in got)


def test_problem_groups_have_no_silent_rate(spark):
    label = STUDY.bands.labels
    rows = [("a", label[0], 5, 100), ("b", label[0], 0, 0), ("c", label[0], 1, 10), ("c", label[0], 1, 10)]
    df = spark.createDataFrame(rows, "g string, band string, cases long, population long")
    standard = spark.createDataFrame([(b, 10) for b in label], "band string, population long")
    got = {r["g"]: (r["std_rate"], r["problem"])
           for r in standardize(df, ["g"], standard, STUDY, aggregated=True).collect()}
    assert got["a"][0] > 0 and got["a"][1] is None
    assert got["b"] == (None, "no population in any band")
    assert got["c"][1] == "a band occurs more than once"
    rates = standardize(df.filter("g <> 'c'"), ["g"], standard, STUDY)
    assert rates.filter("g = 'b'").first()["problem"] == "no population in any band"
    with pytest.raises(Exception, match="no population in any band"):
        sound(rates).collect()
