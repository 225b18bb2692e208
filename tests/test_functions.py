import math

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from equigauge import health_study
from equigauge.config import STATE_BY_CODE, STATES_BY_REGION
from equigauge.functions.age import age_in_years, band_of, band_order
from equigauge.functions.codes import (
    has_padded_prefix, has_prefix, region_of_state, state_of_code,
)
from equigauge.functions.labels import change_label, name_with_state, period_of_year
from equigauge.functions.numeric import clip, half_even, ratio, whole
from equigauge.functions.text import (
    clean_upper, file_name_parts, lenient_double, locale_double, strip, year_of_period, zero_pad,
)

STUDY = health_study()


def test_cohort_prefixes(column_of):
    codes = ["E100", "E110", "E120", "E130", "E140", "E150", "E059", "I10", "N180", " e119 ", None]
    got = column_of(codes, "string", lambda c: has_prefix(F.col(c), STUDY.cohort_prefixes))
    assert got == [True] * 5 + [False] * 4 + [True, False]


def test_severe_procedures_are_padded_first(column_of):
    codes = ["0408050020", "0408010010", "408050020", None, "0408050020123", ""]
    got = column_of(codes, "string", lambda c: has_padded_prefix(F.col(c), STUDY.severe_prefix))
    assert got == [True, False, True, False, True, False]


def test_coded_age(spark):
    rows = [(45, 4, 45.0), (2, 5, 102.0), (15, 2, 0.0), (8, 3, 0.0), (30, 9, None), (-5, 4, None),
            (None, 2, 0.0), (-3, 3, 0.0), (None, 4, None), (7, None, None)]
    df = spark.createDataFrame(rows, "value int, unit int, expected double")
    got = df.select("expected", age_in_years(F.col("value"), F.col("unit")).alias("years"))
    assert [tuple(r) for r in got.collect()] == [(e, e) for _, _, e in rows]


def test_band_edges(column_of):
    ages = [0.0, 29.0, 29.5, 30.0, 39.0, 40.0, 59.0, 60.0, 79.0, 80.0, 105.0, None, math.nan]
    got = column_of(ages, "double", lambda c: band_of(F.col(c), STUDY.bands))
    assert got == ["<30", "<30", "30-39", "30-39", "30-39", "40-49", "50-59", "60-69", "70-79",
                   "80+", "80+", None, None]
    order = column_of(["<30", "80+", "?"], "string", lambda c: band_order(F.col(c), STUDY.bands))
    assert order == [1, 7, None]


def test_states_and_regions(column_of):
    codes = ["355030", " 2304400", "120001", "990000", "x", None]
    assert column_of(codes, "string", lambda c: state_of_code(F.col(c))) == [
        "SP", "CE", "AC", None, None, None]
    states = ["SP", "CE", "AC", "RS", "GO", " sp ", "ZZ", None]
    assert column_of(states, "string", lambda c: region_of_state(F.col(c))) == [
        "Sudeste", "Nordeste", "Norte", "Sul", "Centro-Oeste", "Sudeste", None, None]


def test_every_state_has_one_region():
    states = [s for group in STATES_BY_REGION.values() for s in group]
    assert sorted(states) == sorted(STATE_BY_CODE.values())
    assert len(states) == len(set(states)) == 27


def test_text_cleaning(column_of):
    assert column_of(["\t a b \n", "\xa0x ", None], "string", lambda c: strip(F.col(c))) == [
        "a b", "x", None]
    assert column_of([" ab "], "string", lambda c: clean_upper(F.col(c))) == ["AB"]
    assert column_of(["7", "12345"], "string", lambda c: zero_pad(F.col(c), 3)) == ["007", "12345"]


def test_lenient_numbers(column_of):
    texts = ["5", " 5 ", "1e3", "-.5", "", "x", "nan", "NaN", "1d", "2f", "inf", "Infinity", None]
    got = column_of(texts, "string", lambda c: lenient_double(F.col(c)))
    assert got == [5.0, 5.0, 1000.0, -0.5] + [None] * 9


@settings(max_examples=20, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=32), min_size=1, max_size=20))
def test_lenient_numbers_read_every_float(column_of, numbers):
    got = column_of([repr(x) for x in numbers], "string", lambda c: lenient_double(F.col(c)))
    assert got == numbers


def test_locale_numbers(column_of):
    texts = ["1.234,56", "85,3", "85.3", "1234", "n/a", None]
    got = column_of(texts, "string", lambda c: locale_double(F.col(c)))
    assert got == [1234.56, 85.3, 85.3, 1234.0, None, None]


def test_period_years(column_of):
    got = column_of(["201907", "03/2022", " 202012 ", None], "string",
                    lambda c: year_of_period(F.col(c)))
    assert got == [2019, 2022, 2020, None]


def test_file_names(spark):
    names = ["RDSP1901.dbc", "rdac2412", "RDSP1913.dbc", "PASP1901.dbc", "xRDSP1901.dbc"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = df.select(*[c.alias(k) for k, c in file_name_parts(F.col("name")).items()]).collect()
    assert [tuple(r) for r in got] == [
        ("SP", 2019, 1), ("AC", 2024, 12), (None,) * 3, (None,) * 3, (None,) * 3]
    old = spark.createDataFrame([("RDSP9601.dbc",)], "name string")
    year = lambda *range_: old.select(file_name_parts(F.col("name"), *range_)["year"]).first()[0]
    assert year() is None and year((1990, 2010)) == 1996


def test_clip_keeps_missing_values(column_of):
    got = column_of([1.0, 5.0, 9.0, None], "double", lambda c: clip(F.col(c), F.lit(2.0), F.lit(8.0)))
    assert got == [2.0, 5.0, 8.0, None]


def test_rounding_and_ratios(column_of):
    assert column_of([0.125, 0.135], "double", lambda c: half_even(F.col(c), 2)) == [0.12, 0.14]
    assert column_of([2.5, 3.5, None], "double", lambda c: whole(F.col(c))) == [2, 4, None]
    assert column_of([0.0, 4.0], "double", lambda c: ratio(F.lit(2), F.col(c), 100)) == [None, 50.0]


def test_labels(column_of, spark):
    assert column_of([0.1, -0.1, 0.0, None], "double", lambda c: change_label(F.col(c))) == [
        "Piorou", "Melhorou", "Estavel", "Estavel"]
    assert column_of([2019, 2021, 2024], "int", lambda c: period_of_year(F.col(c), STUDY)) == [
        "2019", "", "2023-24"]
    assert column_of(["A", None], "string",
                     lambda c: name_with_state(F.col(c), F.lit("SP"))) == ["A (SP)", None]
