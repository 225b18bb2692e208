import pytest
from pyspark.sql import functions as F

from equigauge import health_study
from equigauge.config import SEX_BY_RECORD_CODE
from equigauge.operators import GOLD_COLUMNS
from equigauge.operators.cohort import (
    BRONZE_COLUMNS, RAW_COLUMNS, drop_continuations, keep_present, select_cohort, to_bronze,
)
from equigauge.functions.numeric import money_sum
from equigauge.operators.grid import dense_grid, grid_size
from equigauge.operators.measures import calibrate_cuts, measures, slice_by
from equigauge.operators.rollup import (
    code_lookup, duplicate_codes, expand_code, first_attributes, label_sex, merge_cells, roll_up,
)

STUDY = health_study()
RAW = ("MUNIC_RES string, SEXO string, IDADE int, COD_IDADE string, DIAG_PRINC string, "
       "PROC_REA string, IDENT string, MORTE int, VAL_TOT double, DIAS_PERM int, "
       "year int, month int")


@pytest.fixture
def raw(spark):
    rows = [
        ("355030", "1", 45, "4", "E119", "0408050020", "1", 0, 100.1, 3, 2019, 1),
        ("355030", "1", 47, "4", "E119", "408050020", None, 1, 200.2, 5, 2019, 2),
        ("355030", "3", 10, "9", "E100", "0408010010", "x", 0, 50.0, 2, 2019, 3),
        ("355030", "1", 45, "4", "E119", "0408050020", "5", 0, 999.0, 9, 2019, 3),
        ("999999", "3", 2, "5", "e10 ", None, "1", 0, 10.0, 1, 2019, 4),
        ("230440", "0", 70, "4", "E149", None, "1", 0, 10.0, 1, 2023, 4),
        ("230440", "3", 70, "4", "I10", None, "1", 0, 10.0, 1, 2023, 4),
    ]
    return spark.createDataFrame(rows, RAW)


def test_continuations_go_and_unreadable_rows_stay(spark):
    df = spark.createDataFrame(
        [("1", "a"), ("5", "b"), ("1", "c"), (None, "d"), ("?", "e"), (" 5.0", "f")],
        "IDENT string, x string")
    assert [r["x"] for r in drop_continuations(df).collect()] == ["a", "c", "d", "e"]
    typed = spark.createDataFrame([(5, "a"), (1, "b"), (None, "c")], "IDENT int, x string")
    assert [r["x"] for r in drop_continuations(typed).collect()] == ["b", "c"]


def test_cohort_and_flag(raw):
    got = select_cohort(raw, STUDY).orderBy("month", "MUNIC_RES").collect()
    assert [r["severe"] for r in got] == [True, True, False, False, False]


def test_bronze_schema_and_unknown_band(raw):
    got = to_bronze(raw, STUDY)
    assert tuple(got.columns) == BRONZE_COLUMNS
    bands = {(r["code"], r["month"]): (r["age_years"], r["band"]) for r in got.collect()}
    assert bands[("355030", 3)] == (None, None)
    assert bands[("999999", 4)] == (102.0, "80+")
    assert keep_present(raw, (*RAW_COLUMNS, "absent")).columns == list(RAW_COLUMNS)


def test_roll_up_counts_known_ages_only(raw):
    row = roll_up(to_bronze(raw, STUDY)).filter("band = '40-49'").first()
    assert (row["cases"], row["severe"], row["deaths"], row["cost"], row["stay_days"],
            row["age_sum"], row["age_known"]) == (2, 2, 1, pytest.approx(300.3), 8, 92.0, 2)
    unknown = roll_up(to_bronze(raw, STUDY)).filter("band IS NULL").first()
    assert unknown["cases"] == 1 and unknown["age_sum"] is None and unknown["age_known"] == 0


@pytest.fixture
def population(spark):
    rows = [(e, s, u, r, b, 100) for e, u, r in (("3550308", "SP", "Sudeste"),
                                                ("2304400", "CE", "Nordeste"))
            for s in STUDY.sexes for b in STUDY.bands.labels]
    return spark.createDataFrame(
        rows, "entity string, sex string, state string, region string, band string, "
              "population long")


@pytest.fixture
def gold(spark, raw, population):
    lookup = code_lookup(population.select("entity").distinct(), 6)
    silver = expand_code(roll_up(to_bronze(raw, STUDY)), lookup)
    coverage = spark.createDataFrame([("3550308", 2019, 80.0)], "entity string, year int, coverage double")
    return dense_grid(population, STUDY.years, merge_cells(label_sex(silver, SEX_BY_RECORD_CODE)),
                      coverage)


def test_grid_is_dense_and_zero_filled(gold):
    assert tuple(gold.columns) == GOLD_COLUMNS
    size = grid_size(gold, STUDY).first()
    assert size["rows"] == size["expected"] == 2 * 6 * 2 * 7 and size["complete"]
    sums = gold.agg(F.sum("cases").alias("c"), F.count_if(F.col("cases").isNull()).alias("n"),
                    F.count("coverage").alias("v"), F.sum("population").alias("p")).first()
    # Unknown entity, unknown sex code and unknown band have no cell.
    assert (sums["c"], sums["n"], sums["v"], sums["p"]) == (2, 0, 14, 2 * 6 * 14 * 100)
    missing = grid_size(gold.filter("NOT (year = 2020 AND sex = 'M')"), STUDY).first()
    assert not missing["complete"]


def test_codes(spark):
    lookup = spark.createDataFrame([("3550308",), ("2304400",), ("2304401",)], "entity string")
    short = code_lookup(lookup, 6)
    assert [r["code"] for r in duplicate_codes(short).collect()] == ["230440"]
    df = spark.createDataFrame([(" 355030 ",), ("999999",)], "code string")
    assert {tuple(r) for r in expand_code(df, short).collect()} == {
        ("355030", "3550308"), ("999999", None)}


def test_a_shared_code_raises(spark):
    lookup = spark.createDataFrame([("23", "230"), ("23", "231"), ("35", "350")], "code string, entity string")
    df = spark.createDataFrame([("35", 4)], "code string, cases int")
    assert expand_code(df, lookup).first()["entity"] == "350"
    with pytest.raises(Exception, match="code of several entities: 23"):
        expand_code(df.withColumn("code", F.lit("23")), lookup).collect()


def test_money_is_not_rounded_before_it_is_added(spark):
    rows = spark.range(1000).select(F.lit(0.004).alias("cost"), F.lit(99999999999999.5).alias("much"))
    total = rows.agg(money_sum("cost").alias("a"), money_sum("much").alias("b")).first()
    assert total["a"] == pytest.approx(4.0) and total["b"] == pytest.approx(1000 * 99999999999999.5)


def test_merge_adds_rows_that_share_a_key(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 1, 3), ("b", None, 9)], "k string, j int, n long")
    assert [tuple(r) for r in merge_cells(df, ["k", "j"], ["n"]).collect()] == [("a", 1, 5)]


def test_first_known_attribute(spark):
    df = spark.createDataFrame([("a", None), ("a", "SP"), ("b", None)], "entity string, state string")
    assert {tuple(r) for r in first_attributes(df, "entity", ["state"]).collect()} == {
        ("a", "SP"), ("b", None)}


def test_measures_and_slices(gold):
    everything = measures(gold).first()
    assert everything["years_in_context"] == 6
    assert everything["population"] == 2 * 14 * 100
    assert everything["annual_rate"] == pytest.approx(2 / 6 / 2800 * 1e5)
    assert everything["mean_coverage"] == 80.0
    empty = measures(slice_by(gold, year=2020, state="SP"), names=["cases", "severe_frac"]).first()
    assert tuple(empty) == (0, None)
    assert slice_by(gold, year=[2019, 2020], sex=None).select("year").distinct().count() == 2


def test_cut_calibration(spark):
    df = spark.createDataFrame([("a", 5, 10), ("b", 25, 90)],
                               "entity string, total_cases long, population long")
    got = {r["cut"]: tuple(r)[1:] for r in calibrate_cuts(df, [10, 30]).collect()}
    assert got == {10: (2, 1, 50.0, 90.0), 30: (2, 2, 100.0, None)}
