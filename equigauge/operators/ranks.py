"""Exact order statistics and ranks without putting a group into one task.

Values are first counted, so ties of any size become one row; the distinct values are then range
partitioned, and only the per-slice totals are added up across slices. Every window below is
bounded: by one range slice, or by the number of slices.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from equigauge.functions.text import nan_to_null
from equigauge.session import staged


#: Distinct values of one slice, about.
SLICE_VALUES = 100_000


def slice_count(values: int) -> int:
    return max(1, -(-values // SLICE_VALUES))


def value_positions(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Distinct values per group with ``n`` copies, ``before`` smaller rows and group ``total``."""
    by = list(by)
    counts = (
        df.withColumn(value, nan_to_null(F.col(value)))
        .dropna(subset=[*by, value])
        .groupBy(*by, value)
        .agg(F.count("*").alias("n"))
    )
    return _positions_of_counts(counts, by, value)


def _positions_of_counts(counts: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """`value_positions` of rows that are already one per distinct value, with ``n`` copies."""
    # Range boundaries come from a sample, so what is sampled and the slices are written once and
    # then only read. There are as many slices as the distinct values need, whatever the session's
    # number of shuffle partitions.
    counts = staged(counts, "counted-values")
    parts = slice_count(counts.count())
    slices = staged(
        counts.repartitionByRange(parts, *by, value).withColumn("_slice", F.spark_partition_id()),
        "slices",
    )
    slice_keys = [*by, "_slice"]
    within = Window.partitionBy(*slice_keys).orderBy(value).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    across = Window.partitionBy(*by)
    offsets = (
        slices.groupBy(*slice_keys)
        .agg(F.sum("n").alias("_slice_n"))
        .select(
            *slice_keys,
            (F.sum("_slice_n").over(across.orderBy("_slice")) - F.col("_slice_n")).alias(
                "_offset"
            ),
            F.sum("_slice_n").over(across).alias("total"),
        )
    )
    return (
        slices.withColumn("_upto", F.sum("n").over(within))
        .join(offsets, slice_keys)
        .select(
            *by, value, "n", (F.col("_offset") + F.col("_upto") - F.col("n")).alias("before"),
            "total",
        )
    )


def quantile_columns(value: str, probabilities: dict[str, float]) -> list[Column]:
    """Aggregates over `value_positions` rows: linearly interpolated quantiles."""
    out = []
    for name, p in probabilities.items():
        at = (F.col("total") - 1) * F.lit(float(p))
        low = F.floor(at)
        high = F.ceil(at)
        at_position = lambda k: F.max(
            F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col(value))
        )
        fraction = F.max(at - low)
        out.append(
            (at_position(low) + fraction * (at_position(high) - at_position(low))).alias(name)
        )
    return out


def quantiles(
    df: DataFrame, by: Sequence[str], value: str, probabilities: dict[str, float]
) -> DataFrame:
    """Exact quantiles per group (named by the keys of ``probabilities``)."""
    return value_positions(df, by, value).groupBy(*by).agg(
        *quantile_columns(value, probabilities)
    )


def quantiles_approx(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probabilities: dict[str, float],
    accuracy: int = 10_000,
) -> DataFrame:
    """Sketch quantiles: one pass, bounded memory, a different (approximate) result."""
    return df.groupBy(*by).agg(
        *[
            F.percentile_approx(value, float(p), accuracy).alias(name)
            for name, p in probabilities.items()
        ]
    )


def average_ranks(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Average rank (ties share their mean) of each distinct value per group."""
    return value_positions(df, by, value).select(
        *by,
        value,
        "n",
        "total",
        (F.col("before") + (F.col("n") + 1) / 2.0).alias("rank"),
    )


def spearman(
    df: DataFrame, by: Sequence[str], x: str, y: str, min_rows: int = 2
) -> DataFrame:
    """Rank correlation and number of complete pairs per group.

    Pairs are counted before they meet their ranks, and the mean of average ranks is known to be
    (n + 1) / 2, so one pass of centred sums is enough. Groups below ``min_rows`` give null.
    """
    by = list(by)
    pairs = (
        df.select(
            *by, nan_to_null(F.col(x)).alias("_x"), nan_to_null(F.col(y)).alias("_y")
        )
        .dropna(subset=[*by, "_x", "_y"])
        .groupBy(*by, "_x", "_y")
        .agg(F.count("*").alias("_pairs"))
    )
    pairs = staged(pairs, "pairs")
    axes = pairs.select(
        *by,
        "_pairs",
        F.inline(
            F.array(
                F.struct(F.lit("x").alias("_axis"), F.col("_x").alias("_value")),
                F.struct(F.lit("y").alias("_axis"), F.col("_y").alias("_value")),
            )
        ),
    )
    ranks = _weighted_ranks(axes, [*by, "_axis"], "_value", "_pairs")
    axis = lambda name, value, rank: ranks.filter(F.col("_axis") == name).select(
        *by, F.col("_value").alias(value), F.col("_rank").alias(rank), "_total"
    )
    joined = pairs.join(axis("x", "_x", "_rx"), [*by, "_x"]).join(
        axis("y", "_y", "_ry").drop("_total"), [*by, "_y"]
    )
    dx = F.col("_rx") - (F.col("_total") + 1) / 2.0
    dy = F.col("_ry") - (F.col("_total") + 1) / 2.0
    weight = F.col("_pairs")
    result = joined.groupBy(*by).agg(
        F.sum(weight).alias("n"),
        F.sum(weight * dx * dy).alias("_xy"),
        F.sum(weight * dx * dx).alias("_xx"),
        F.sum(weight * dy * dy).alias("_yy"),
    )
    rho = F.try_divide(F.col("_xy"), F.sqrt(F.col("_xx") * F.col("_yy")))
    return result.select(
        *by, "n", F.when(F.col("n") >= min_rows, rho).alias("spearman")
    )


def _weighted_ranks(df: DataFrame, by: Sequence[str], value: str, weight: str) -> DataFrame:
    counts = df.groupBy(*by, value).agg(F.sum(weight).alias("n"))
    positions = _positions_of_counts(counts, by, value)
    return positions.select(
        *by,
        value,
        (F.col("before") + (F.col("n") + 1) / 2.0).alias("_rank"),
        F.col("total").alias("_total"),
    )
