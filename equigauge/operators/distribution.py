"""Distributions, correlations and summaries."""

from __future__ import annotations

from itertools import combinations_with_replacement
from typing import Sequence

from pyspark.sql import DataFrame, functions as F

from equigauge.functions.text import nan_to_null
from equigauge.operators.ranks import quantile_columns, quantiles, spearman, value_positions

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def pearson_matrix(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Pairwise-complete correlations per group as (group, x, y, r) rows; one aggregation."""
    pairs = list(combinations_with_replacement(columns, 2))
    x = lambda c: nan_to_null(F.col(c))
    wide = df.groupBy(*by).agg(
        *[F.corr(x(a), x(b)).alias(f"_r{i}") for i, (a, b) in enumerate(pairs)]
    )
    cells = []
    for i, (a, b) in enumerate(pairs):
        for left, right in {(a, b), (b, a)}:
            cells.append(
                F.struct(F.lit(left).alias("x"), F.lit(right).alias("y"), F.col(f"_r{i}").alias("r"))
            )
    return wide.select(*by, F.inline(F.array(*cells)))


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Equal-width bins between minimum and maximum, empty bins included.

    The top edge belongs to the last bin. The result has exactly ``bins`` rows.
    """
    x = nan_to_null(F.col(column))
    ends = df.agg(
        F.struct(F.min(x).alias("low"), F.max(x).alias("high"))
    ).scalar()
    # A constant column has no width (null bucket): everything is in the first bin.
    bucket = F.coalesce(
        F.width_bucket(x, ends["low"], ends["high"], F.lit(bins)), F.lit(1).cast("long")
    )
    spot = F.when(x.isNotNull(), F.least(bucket, F.lit(bins).cast("long")))
    counts = df.select(spot.alias("bin")).agg(
        F.array(*[F.count_if(F.col("bin") == i) for i in range(1, bins + 1)]).alias("counts")
    )
    width = (ends["high"] - ends["low"]) / F.lit(float(bins))
    edges = counts.select(F.posexplode("counts").alias("_i", "rows"))
    return edges.select(
        (F.col("_i") + 1).alias("bin"),
        (ends["low"] + F.col("_i") * width).alias("lower"),
        (ends["low"] + (F.col("_i") + 1) * width).alias("upper"),
        "rows",
    )


def box_summary(df: DataFrame, by: Sequence[str], column: str, whisker: float = 1.5) -> DataFrame:
    """Quartiles, whisker ends (furthest value within 1.5 IQR) and outlier count per group."""
    positions = value_positions(df, by, column)
    boxes = positions.groupBy(*by).agg(*quantile_columns(column, QUARTILES))
    reach = F.lit(float(whisker)) * (F.col("q3") - F.col("q1"))
    inside = F.col(column).between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        positions.join(boxes, list(by))
        .groupBy(*by)
        .agg(
            F.sum("n").alias("n"),
            *[F.min(q).alias(q) for q in QUARTILES],
            F.min(F.when(inside, F.col(column))).alias("whisker_low"),
            F.max(F.when(inside, F.col(column))).alias("whisker_high"),
            F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("outliers"),
        )
    )


def describe(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, standard deviation, extremes and exact quartiles."""
    x = F.col(column)
    positions = value_positions(df, by, column)
    n, total = F.sum("n"), F.sum(x * F.col("n"))
    mean = total / n
    moments = positions.groupBy(*by).agg(
        n.alias("count"),
        mean.alias("mean"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        *quantile_columns(column, {"q25": 0.25, "q50": 0.5, "q75": 0.75}),
    )
    # Deviations from the mean, in a second look at the same staged values.
    if by:
        centred = positions.join(moments.select(*by, "mean"), list(by))
        centre = F.col("mean")
    else:
        centred, centre = positions, moments.select("mean").scalar()
    squares = centred.select(*by, ((x - centre) * (x - centre) * F.col("n")).alias("_s"), "n")
    deviation = squares.groupBy(*by).agg(
        F.sqrt(F.try_divide(F.sum("_s"), F.sum("n") - 1)).alias("std")
    )
    if by:
        out = moments.join(deviation, list(by))
    else:
        out = moments.withColumn("std", deviation.scalar())
    return out.select(
        *by, "count", "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def context_correlation(
    components: DataFrame, context: str = "coverage", measure: str = "std_rate", min_rows: int = 30
) -> DataFrame:
    """Rank correlation of context and measure inside each period, never across periods.

    Where the rows name their ``source``, a period that mixes sources raises: within it, methods
    would be compared.
    """
    if "source" in components.columns:
        mixed = single_source(components).agg(F.count("*").alias("n")).scalar()
        components = components.withColumn(
            context,
            F.when(mixed == 0, F.col(context)).otherwise(
                F.raise_error(F.lit("a period mixes sources")).cast("double")
            ),
        )
    return spearman(components, ["period"], context, measure, min_rows)


def context_profile(
    components: DataFrame, by: Sequence[str] = ("period", "region"), context: str = "coverage"
) -> DataFrame:
    """Median, mean and count of the context variable; groups without any value stay."""
    x = nan_to_null(F.col(context))
    sizes = components.groupBy(*by).agg(F.avg(x).alias("mean"), F.count(x).alias("count"))
    medians = quantiles(components, by, context, {"median": 0.5})
    return sizes.join(medians, list(by), "left").select(
        *by, F.bround("median", 1).alias("median"), F.bround("mean", 1).alias("mean"), "count"
    )


def single_source(df: DataFrame, source: str = "source", by: Sequence[str] = ("period",)) -> DataFrame:
    """Periods that mix coverage sources; comparing within them would compare methods."""
    return df.groupBy(*by).agg(F.countDistinct(source).alias("sources")).filter("sources > 1")


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("rows"))


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, nulls) rows from one aggregation."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.select(
        F.inline(
            F.array(
                *[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in columns]
            )
        )
    )
