import pytest
from pyspark.sql import functions as F

from equigauge import health_study
from equigauge.operators.validate import (
    check_export, check_ranges, completeness_of, export_checks, loss_account,
    missing_inputs, orphan_denominators, orphan_key_share, population_contract, reconcile,
    reject_gate, reject_summary,
)

STUDY = health_study()


def test_completeness_of_frames(spark):
    expected = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "file string")
    done = spark.createDataFrame([("a",), ("a",)], "file string")
    row = completeness_of(expected, done, ["file"]).first()
    assert (row["expected"], row["processed"], row["missing"], row["passed"]) == (3, 1, 2, False)
    assert {r["file"] for r in missing_inputs(expected, done, ["file"]).collect()} == {"b", "c"}


def test_orphan_denominators(spark):
    df = spark.createDataFrame(
        [("a", 3, None), ("b", 3, "0"), ("c", 3, "-1"), ("d", 3, "x"), ("e", 3, "10"), ("f", 0, None)],
        "entity string, cases int, population string")
    assert {r["entity"] for r in orphan_denominators(df).collect()} == {"a", "b", "c", "d"}


@pytest.mark.parametrize("measure, value, fails", [
    ("std_rate", -1.0, True), ("index", 1.4, True), ("death_frac", 1.5, True),
    ("coverage", 104.7, False), ("coverage", 803.21, False), ("coverage", 1500.0, True),
    ("coverage", -3.0, True), ("index", None, False)])
def test_ranges(spark, measure, value, fails):
    df = spark.createDataFrame([(0.5,), (value,)], f"`{measure}` double")
    if fails:
        with pytest.raises(ValueError, match=measure):
            check_ranges(df)
    else:
        check_ranges(df)


def test_first_bad_measure_is_named(spark):
    df = spark.createDataFrame([(2.0, -1.0)], "index double, std_rate double")
    with pytest.raises(ValueError, match="std_rate"):
        check_ranges(df)


def test_reconciliation(spark):
    schema = "state string, year int, cases long"
    ours = spark.createDataFrame([("SP", 2019, 1000), ("CE", 2019, 500), ("AC", 2019, 7),
                                  ("RR", 2019, 1)], schema)
    theirs = spark.createDataFrame([("SP", 2019, 1005), ("CE", 2019, 900), ("TO", 2019, 3),
                                    ("RR", 2019, 0)], schema)
    got = {r["state"]: r for r in reconcile(ours, theirs).collect()}
    assert {k: r["passed"] for k, r in got.items()} == {
        "SP": True, "CE": False, "AC": False, "TO": False, "RR": False}
    assert got["SP"]["difference"] == -5 and got["AC"]["relative_error"] is None


def test_orphan_share_gate(spark):
    df = spark.createDataFrame([("a",)] * 99 + [(None,)], "entity string")
    row = orphan_key_share(df).first()
    assert row["share"] == 0.01 and not row["passed"]
    assert orphan_key_share(df.dropna()).first()["passed"]


def test_losses_by_reason(spark):
    rows = [("e", "1", "b", 5), (None, "1", "b", 3), ("e", "0", "b", 2), ("e", None, "b", 1),
            (None, "9", None, 4)]
    df = spark.createDataFrame(rows, "entity string, sex string, band string, cases long")
    row = loss_account(df, ["1", "3"]).first()
    assert row.asDict() == {
        "cases": 15, "rows_without_entity": 2, "rows_with_other_sex": 2, "cases_without_entity": 7,
        "cases_without_sex": 7, "cases_without_band": 4, "cases_outside_grid": 10}


def test_export_checks(spark):
    source = spark.createDataFrame([(3,), (4,)], "cases long")
    named = spark.createDataFrame([("a", "A")], "entity string, name string")
    check_export(export_checks(source, source, named))
    with pytest.raises(ValueError, match="does not match"):
        check_export(export_checks(source, source.limit(1), named))
    with pytest.raises(ValueError, match="does not match"):
        check_export(export_checks(source, source, named.withColumn("name", F.lit(None))))


def test_population_contract(spark):
    regions = ("Norte", "Nordeste", "Centro-Oeste", "Sudeste", "Sul")
    rows = [(f"{i}550308", s, b, 100, r) for i, r in enumerate(regions)
            for s in STUDY.sexes for b in STUDY.bands.labels]
    schema = "entity string, sex string, band string, population long, region string"
    check = lambda df, total: {
        r["rule"]: r["violations"]
        for r in population_contract(df, STUDY.bands, STUDY.sexes, 7, 5, total).collect()}
    good = spark.createDataFrame(rows, schema)
    assert set(check(good, 7000).values()) == {0}
    bad = spark.createDataFrame(
        [("355030", "X", "?", -1, "Norte"), (None, None, None, None, None)], schema)
    got = check(bad, 7000)
    assert got == {"key_length": 2, "unknown_band": 2, "missing_band": 7, "unknown_sex": 2,
                   "missing_sex": 2, "negative": 1, "regions": 1, "total": 1}


def test_reject_gate(spark):
    rejects = spark.range(5).select(F.lit("truncated header").alias("status"))
    assert reject_gate(rejects, 6).count() == 5
    with pytest.raises(ValueError, match="rejected"):
        reject_gate(rejects, 5)
    row = reject_summary(rejects.union(spark.createDataFrame([("ok",)], "status string")), 5).first()
    assert tuple(row) == ("truncated header", 5, True)
