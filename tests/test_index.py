from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from equigauge import health_study
from equigauge.operators.eligibility import (
    exclusion_funnel, rank_by_events, rank_eligibility, ranked_in_both, volume_flag,
)
from equigauge.operators.scale import (
    apply_scale, check_periods, check_scale, composite_index, fit_scale, index_change,
)
from equigauge.operators.sensitivity import shared_top, weight_sensitivity

STUDY = health_study()
BASE, CURRENT = STUDY.base.label, STUDY.current.label


def frame(spark, n=10, shift=0.0, extra_cases=0):
    rows = []
    for label, move in ((BASE, 0.0), (CURRENT, shift)):
        for i, (a, b, c) in enumerate(zip(
            np.linspace(10, 60, n), np.linspace(0.01, 0.06, n), np.linspace(0.02, 0.12, n)
        )):
            rows.append((f"e{i:02d}", label, 30 + extra_cases, float(a + move * 10),
                         float(b + move * 0.01), float(c + move * 0.02)))
    return spark.createDataFrame(
        rows, "entity string, period string, cases long, std_rate double, severe_frac double, "
              "death_frac double")


def test_index_is_between_zero_and_one_and_worst_is_one(spark):
    got = composite_index(frame(spark), STUDY).toPandas()
    assert got["index"].between(0, 1).all()
    worst = got[got["entity"] == "e09"]
    assert worst["index"].to_numpy() == pytest.approx([1.0, 1.0])


def test_both_periods_share_one_ruler(spark):
    got = composite_index(frame(spark, shift=1.0), STUDY).toPandas()
    means = got.groupby("period")["index"].mean()
    assert means[CURRENT] > means[BASE]


def test_ruler_matches_two_pass_fit(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({c: rng.exponential(5, 400) for c in STUDY.components})
    pdf.iloc[::13, 0] = np.nan
    df = spark.createDataFrame([tuple(None if pd.isna(v) else float(v) for v in r)
                                for r in pdf.itertuples(index=False)],
                               "std_rate double, severe_frac double, death_frac double")
    ruler = check_scale(fit_scale(df, STUDY), STUDY)
    for c in STUDY.components:
        low, high = pdf[c].quantile(0.01), pdf[c].quantile(0.99)
        clipped = pdf[c].clip(low, high)
        assert [ruler[c][k] for k in ("low", "high", "min", "max")] == pytest.approx(
            [low, high, clipped.min(), clipped.max()])


def test_constant_component_is_an_error(spark):
    with pytest.raises(ValueError, match="constant component"):
        composite_index(frame(spark).withColumn("death_frac", F.lit(0.5)), STUDY)


def test_foreign_ruler_clips_to_its_range(spark):
    ruler = check_scale(fit_scale(frame(spark), STUDY), STUDY)
    other = frame(spark, shift=50.0).filter(F.col("period") == CURRENT)
    assert {r["index"] for r in apply_scale(other, ruler, STUDY).collect()} == {1.0}


def test_missing_component_gives_missing_index(spark):
    ruler = check_scale(fit_scale(frame(spark), STUDY), STUDY)
    holed = frame(spark).withColumn("death_frac", F.lit(None).cast("double"))
    assert all(r["index"] is None for r in apply_scale(holed, ruler, STUDY).collect())


def test_inverted_component(spark):
    study = replace(STUDY, inverted=("std_rate",))
    got = composite_index(frame(spark), study).filter("entity = 'e09'").first()
    assert got["std_rate_norm"] == 0.0 and got["index"] == pytest.approx(2 / 3)


def test_weights(spark):
    weights = dict(zip(STUDY.components, (1.0, 0.0, 0.0)))
    got = composite_index(frame(spark), STUDY, weights).toPandas()
    assert got["index"].to_numpy() == pytest.approx(got["std_rate_norm"].to_numpy())
    with pytest.raises(ValueError, match="sum to 1"):
        composite_index(frame(spark), STUDY, dict.fromkeys(STUDY.components, 0.5))
    with pytest.raises(ValueError, match="name the components"):
        composite_index(frame(spark), STUDY, {"std_rate": 1.0})


def test_change_is_negative_when_all_get_better(spark):
    got = index_change(composite_index(frame(spark, shift=-0.5), STUDY), STUDY)
    assert got.columns == ["entity", "index_2019", "index_2023_24", "change"]
    assert all(r["change"] < 0 for r in got.filter("index_2019 < 1 AND index_2019 > 0.1").collect())


def test_change_with_one_period(spark):
    scored = composite_index(frame(spark), STUDY)
    lone = scored.filter((F.col("entity") != "e03") | (F.col("period") == BASE))
    row = index_change(lone, STUDY).filter("entity = 'e03'").first()
    assert row["index_2019"] is not None and row["change"] is None
    with pytest.raises(ValueError, match="2023-24"):
        check_periods(scored.filter(F.col("period") == BASE), STUDY.periods)


def flagged(spark, counts, totals):
    rows = [(e, p, n) for e, pair in counts.items() for p, n in zip((BASE, CURRENT), pair)
            if n is not None]
    stacked = spark.createDataFrame(rows, "entity string, period string, cases long")
    sums = spark.createDataFrame(list(totals.items()), "entity string, total_cases long")
    return rank_eligibility(stacked, sums, STUDY)


COUNTS = {"in": (12, 10), "low": (8, 9), "thin": (40, 2), "gone": (40, None), "other": (30, 30)}
TOTALS = {"in": 40, "low": 19, "thin": 60, "gone": 90, "other": 80}


def test_two_ranking_rules(spark):
    got = {r["entity"]: (r["passed_total"], r["passed_period"], r["ranked"])
           for r in flagged(spark, COUNTS, TOTALS).collect()}
    assert got == {"in": (True, True, True), "low": (False, True, False),
                   "thin": (True, False, False), "gone": (True, False, False),
                   "other": (True, True, True)}
    assert {r["entity"] for r in ranked_in_both(flagged(spark, COUNTS, TOTALS)).collect()} == {
        "in", "other"}


def test_one_pass_over_the_events_gives_the_same_flags(spark):
    base, current, other = STUDY.base.years[0], STUDY.current.years[0], STUDY.years[1]
    rows = [(e, y, n) for e, pair in COUNTS.items() for y, n in zip((base, current), pair) if n is not None]
    rows += [(e, other, n - sum(x or 0 for x in COUNTS[e])) for e, n in TOTALS.items()]
    events = spark.createDataFrame(rows, "entity string, year int, cases long")
    want = {(r["entity"], r["period"]): r.asDict() for r in flagged(spark, COUNTS, TOTALS).collect()}
    got = {(r["entity"], r["period"]): r.asDict() for r in rank_by_events(events, STUDY).collect()}
    assert got == want
    with pytest.raises(Exception, match="a period is absent"):
        rank_by_events(events.filter(F.col("year") != base), STUDY).collect()


def test_missing_total_is_an_error(spark):
    with pytest.raises(Exception, match="without a total: in"):
        flagged(spark, COUNTS, {k: v for k, v in TOTALS.items() if k != "in"}).collect()


def test_missing_period_is_an_error(spark):
    one = {e: (n, None) for e, (n, _) in COUNTS.items()}
    with pytest.raises(Exception, match="a period is absent"):
        flagged(spark, one, TOTALS).collect()
    scored = composite_index(frame(spark), STUDY).filter(F.col("period") == BASE)
    with pytest.raises(Exception, match="a period is absent"):
        index_change(scored, STUDY).collect()


def test_funnel_parts_add_up(spark):
    rows = exclusion_funnel(flagged(spark, COUNTS, TOTALS)).orderBy("step").collect()
    assert [(r["reason"], r["entities"]) for r in rows] == [
        ("below_total", 1), ("below_period", 2), ("incomplete", 0), ("ranked", 2)]
    assert sum(r["entities"] for r in rows) == rows[0]["total"] == 5


def test_row_flag_compares_each_row(spark):
    df = spark.createDataFrame([("a", 20), ("b", 19)], "entity string, cases long")
    assert [r["ranked"] for r in volume_flag(df, 20).collect()] == [True, False]


def test_sensitivity_of_equal_weights_is_perfect(spark):
    rng = np.random.default_rng(9)
    rows = [(f"e{i:03d}", CURRENT, 30, *map(float, rng.random(3))) for i in range(300)]
    df = spark.createDataFrame(
        rows, "entity string, period string, cases long, std_rate double, severe_frac double, "
              "death_frac double")
    got = {r["scheme"]: r for r in weight_sensitivity(df, STUDY).collect()}
    assert set(got) == {"equal", "outcome", "severity", "access"}
    assert got["equal"]["spearman"] == pytest.approx(1.0) and got["equal"]["overlap"] == 100
    pdf = composite_index(df, STUDY).toPandas()
    alt = composite_index(df, STUDY, STUDY.schemes["access"]).toPandas()
    assert got["access"]["spearman"] == pytest.approx(
        pdf["index"].rank().corr(alt.set_index(pdf.index)["index"].rank()))
    top = lambda p: set(p.nlargest(100, "index")["entity"])
    assert got["access"]["overlap"] == len(top(pdf) & top(alt))


def test_shared_top(spark):
    a = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 1.0)], "entity string, v double")
    b = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "entity string, v double")
    assert shared_top(a, b, "v", 2).first()["shared"] == 1
