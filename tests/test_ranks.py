"""Order statistics against brute force, with a third of all rows on one value."""

import numpy as np
import pandas as pd
import pytest

from equigauge.operators.distribution import (
    QUARTILES, box_summary, context_profile, describe, histogram, null_counts, pearson_matrix,
    value_counts,
)
from equigauge.operators import ranks
from equigauge.operators.ranks import average_ranks, quantiles, quantiles_approx, spearman
from equigauge.operators.scale import min_max, winsorize


@pytest.fixture(autouse=True)
def small_slices(monkeypatch):
    """Many slices, as at full size."""
    monkeypatch.setattr(ranks, "SLICE_VALUES", 150)


def test_slices_follow_the_distinct_values():
    assert [ranks.slice_count(n) for n in (0, 150, 151, 3000)] == [1, 1, 2, 20]


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(11)
    n = 3000
    pdf = pd.DataFrame({
        "g": rng.choice(["a", "b", "c"], n, p=[0.8, 0.15, 0.05]),
        "x": np.where(rng.random(n) < 1 / 3, 100.0, rng.normal(50, 20, n).round(1)),
        "y": rng.exponential(10, n).round(2),
    })
    rows = [(g, x if i % 17 else None, float("nan") if i % 23 == 0 else y)
            for i, (g, x, y) in enumerate(pdf.itertuples(index=False))]
    pdf = pd.DataFrame(rows, columns=["g", "x", "y"])
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(5)
    return df, pdf


def test_quantiles(skewed):
    df, pdf = skewed
    probabilities = {"p1": 0.01, "q1": 0.25, "mid": 0.5, "p99": 0.99, "all": 1.0}
    got = quantiles(df, ["g"], "x", probabilities).toPandas().set_index("g")
    for name, p in probabilities.items():
        expected = pdf.groupby("g")["x"].quantile(p)
        assert got[name].sort_index().to_numpy() == pytest.approx(expected.to_numpy())


def test_quantile_of_one_value_and_of_none(spark):
    df = spark.createDataFrame([("a", 7.0), ("b", None)], "g string, x double")
    assert [tuple(r) for r in quantiles(df, ["g"], "x", {"q": 0.3}).collect()] == [("a", 7.0)]
    assert quantiles(df, [], "x", {"q": 0.3}).collect()[0]["q"] == 7.0


def test_approximate_quantiles_are_near(skewed):
    df, pdf = skewed
    got = quantiles_approx(df.filter("x IS NOT NULL"), ["g"], "x", {"mid": 0.5}).toPandas()
    exact = pdf.groupby("g")["x"].median()
    assert (got.set_index("g")["mid"].sort_index() - exact).abs().max() < 3


def test_average_ranks(skewed):
    df, pdf = skewed
    got = average_ranks(df, ["g"], "x").toPandas()
    expected = pdf.assign(rank=pdf.groupby("g")["x"].rank()).dropna(subset=["x"])
    expected = expected.drop_duplicates(["g", "x"])[["g", "x", "rank"]]
    both = got.merge(expected, on=["g", "x"], suffixes=("", "_brute"), how="outer")
    assert (both["rank"] == both["rank_brute"]).all()


def test_spearman(skewed):
    df, pdf = skewed
    got = spearman(df, ["g"], "x", "y", min_rows=120).toPandas().set_index("g")
    for g, part in pdf.dropna().groupby("g"):
        assert got.loc[g, "n"] == len(part)
        rho = part["x"].rank().corr(part["y"].rank())
        if len(part) < 120:
            assert pd.isna(got.loc[g, "spearman"])
        else:
            assert got.loc[g, "spearman"] == pytest.approx(rho)


def test_spearman_of_constant_is_null(spark):
    df = spark.createDataFrame([("a", 1.0, float(i)) for i in range(5)], "g string, x double, y double")
    assert spearman(df, ["g"], "x", "y").first()["spearman"] is None


def test_describe(skewed):
    df, pdf = skewed
    got = describe(df, "x").first()
    expected = pdf["x"].describe()
    names = {"count": "count", "mean": "mean", "std": "std", "min": "min", "q25": "25%",
             "q50": "50%", "q75": "75%", "max": "max"}
    assert [got[k] for k in names] == pytest.approx([expected[v] for v in names.values()])
    by = describe(df, "x", ["g"]).toPandas().set_index("g").sort_index()
    assert by["std"].to_numpy() == pytest.approx(pdf.groupby("g")["x"].std().to_numpy())


def test_boxes(skewed):
    df, pdf = skewed
    got = box_summary(df, ["g"], "y").toPandas().set_index("g")
    for g, y in pdf.dropna(subset=["y"]).groupby("g")["y"]:
        q1, q3 = y.quantile(0.25), y.quantile(0.75)
        reach = 1.5 * (q3 - q1)
        inside = y[(y >= q1 - reach) & (y <= q3 + reach)]
        row = got.loc[g]
        assert [row[q] for q in QUARTILES] == pytest.approx([q1, y.median(), q3])
        assert (row["whisker_low"], row["whisker_high"]) == (inside.min(), inside.max())
        assert row["outliers"] == len(y) - len(inside)


def test_histogram_counts_every_value_once(skewed, spark):
    df, pdf = skewed
    got = histogram(df, "y", 50).orderBy("bin").toPandas()
    counts, edges = np.histogram(pdf["y"].dropna(), bins=50)
    assert got["rows"].sum() == pdf["y"].notna().sum()
    assert got["lower"].to_numpy() == pytest.approx(edges[:-1])
    assert np.abs(got["rows"].to_numpy() - counts).sum() <= 2
    flat = histogram(spark.createDataFrame([(3.0,)] * 4, "y double"), "y", 5).orderBy("bin")
    assert [r["rows"] for r in flat.collect()] == [4, 0, 0, 0, 0]


def test_pearson_matrix_is_pairwise_complete(skewed):
    df, pdf = skewed
    got = pearson_matrix(df, ["x", "y"], ["g"]).toPandas().set_index(["g", "x", "y"])["r"]
    for g, part in pdf.groupby("g"):
        assert got[g, "x", "y"] == pytest.approx(part["x"].corr(part["y"]))
        assert got[g, "y", "x"] == got[g, "x", "y"]
        assert got[g, "x", "x"] == pytest.approx(1.0)


def test_winsorize(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 4.0, 1000.0, None)], "x double")
    got = [r["x"] for r in winsorize(df, "x", 0.0, 0.75).collect()]
    assert max(v for v in got if v is not None) == 4.0 and got.count(None) == 1


def test_min_max(spark):
    df = spark.createDataFrame([(2.0,), (4.0,), (6.0,), (None,)], "x double")
    assert [r["n"] for r in min_max(df, "x", "n").collect()] == [0.0, 0.5, 1.0, None]
    flat = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    with pytest.raises(Exception, match="constant column"):
        min_max(flat, "x", "n").collect()


def test_small_profiles(spark):
    df = spark.createDataFrame(
        [("p", "r", 96.0), ("p", "r", None), ("p", "s", None)],
        "period string, region string, coverage double")
    rows = {r["region"]: tuple(r)[2:] for r in context_profile(df).collect()}
    assert rows == {"r": (96.0, 96.0, 1), "s": (None, None, 0)}
    assert {tuple(r) for r in value_counts(df, "region").collect()} == {("r", 2), ("s", 1)}
    assert {tuple(r) for r in null_counts(df, ["coverage", "region"]).collect()} == {
        ("coverage", 2), ("region", 0)}
