"""Winsorised min-max scale ("ruler"), composite index and its change."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from equigauge.config import Period, Study
from equigauge.functions.numeric import clip
from equigauge.functions.text import nan_to_null
from equigauge.operators.ranks import quantile_columns, quantiles, value_positions


def winsorize(
    df: DataFrame, column: str, lower: float = 0.01, upper: float = 0.99
) -> DataFrame:
    """Clip a column at its own quantiles; nulls stay null."""
    bounds = quantiles(df, [], column, {"low": lower, "high": upper})
    b = bounds.select(F.struct("low", "high")).scalar()
    return df.withColumn(column, clip(nan_to_null(F.col(column)), b["low"], b["high"]))


def min_max(df: DataFrame, column: str, out: str) -> DataFrame:
    """Map a column to [0, 1]. A constant column has no scale and raises when evaluated."""
    x = nan_to_null(F.col(column))
    ends = df.agg(F.struct(F.min(x).alias("low"), F.max(x).alias("high"))).scalar()
    span = F.when(ends["low"] < ends["high"], ends["high"] - ends["low"]).otherwise(
        F.raise_error(F.lit(f"constant column cannot be normalised: {column}")).cast("double")
    )
    return df.withColumn(out, (x - ends["low"]) / span)


def fit_scale(df: DataFrame, study: Study) -> DataFrame:
    """Ruler: one row per component with its winsor bounds and the range after clipping.

    Interpolated quantiles lie inside the data, so after clipping the minimum is the lower bound
    and the maximum the upper one: a single quantile pass fits everything. All components are
    fitted together by their name as group key.
    """
    long = df.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("component"), F.col(c).cast("double").alias("value"))
                    for c in study.components
                ]
            )
        )
    )
    low, high = study.winsor
    return (
        value_positions(long, ["component"], "value")
        .groupBy("component")
        .agg(*quantile_columns("value", {"low": low, "high": high}))
        .select("component", "low", "high", F.col("low").alias("min"), F.col("high").alias("max"))
    )


def check_scale(ruler: DataFrame, study: Study) -> dict[str, dict[str, float]]:
    """Read the ruler (one short row per component) and raise on a constant or absent one."""
    wanted = ruler.filter(F.col("component").isin(*study.components))
    rows = {r["component"]: r.asDict() for r in wanted.collect()}
    for component in study.components:
        row = rows.get(component)
        if row is None or row["min"] is None or not row["min"] < row["max"]:
            raise ValueError(f"constant component cannot be normalised: {component}")
    return {
        c: {k: float(v) for k, v in rows[c].items() if k != "component"}
        for c in study.components
    }


def check_weights(weights: Mapping[str, float], study: Study) -> dict[str, float]:
    if set(weights) != set(study.components):
        raise ValueError(f"weights must name the components {study.components}")
    if abs(sum(weights.values()) - 1.0) > 1e-9:
        raise ValueError("weights must sum to 1")
    return dict(weights)


def apply_scale(
    df: DataFrame,
    ruler: Mapping[str, Mapping[str, float]],
    study: Study,
    weights: Mapping[str, float] | None = None,
    out: str = "index",
) -> DataFrame:
    """Clip and normalise each component by a given ruler and add the weighted sum.

    The ruler (see `check_scale`) is a handful of numbers, so this is a projection: no join.
    A null component gives a null index.
    """
    weights = check_weights(study.equal_weights if weights is None else weights, study)
    normed = {c: _normalised(c, ruler[c], c in study.inverted) for c in study.components}
    scaled = df.withColumns({f"{c}_norm": col for c, col in normed.items()})
    return scaled.withColumn(out, weighted_index(weights, study.components))


def _normalised(component: str, p: Mapping[str, float], inverted: bool):
    x = clip(nan_to_null(F.col(component)), F.lit(p["low"]), F.lit(p["high"]))
    norm = (x - F.lit(p["min"])) / F.lit(p["max"] - p["min"])
    return F.lit(1.0) - norm if inverted else norm


def weighted_index(weights: Mapping[str, float], components: Sequence[str]):
    total = F.lit(0.0)
    for c in components:
        total = total + F.col(f"{c}_norm") * F.lit(float(weights[c]))
    return total


def composite_index(
    df: DataFrame, study: Study, weights: Mapping[str, float] | None = None
) -> DataFrame:
    """Fit the ruler on the frame itself (both periods stacked) and apply it."""
    return apply_scale(df, check_scale(fit_scale(df, study), study), study, weights)


def check_periods(df: DataFrame, periods: Sequence[Period]) -> None:
    """Raise when a comparison period is absent from the whole frame."""
    labels = [p.label for p in periods]
    seen = df.agg(
        *[F.bool_or(F.col("period") == label).alias(f"p{i}") for i, label in enumerate(labels)]
    ).first()
    missing = [label for i, label in enumerate(labels) if not seen[f"p{i}"]]
    if missing:
        raise ValueError(f"periods absent from the frame: {sorted(missing)}")


def index_change(df: DataFrame, study: Study) -> DataFrame:
    """Index of both periods per entity and current minus base (positive is worse).

    An entity with one period keeps its row with a null change. A period that is absent from the
    whole frame raises when the change is read.
    """
    base, current = study.periods
    present = df.agg(
        (F.coalesce(F.bool_or(F.col("period") == base.label), F.lit(False))
         & F.coalesce(F.bool_or(F.col("period") == current.label), F.lit(False))).alias("both")
    ).scalar()
    wide = (
        df.filter(F.col("index").isNotNull())
        .groupBy("entity")
        .pivot("period", [base.label, current.label])
        .agg(F.min("index"))
    )
    b, c = F.col(f"`{base.label}`"), F.col(f"`{current.label}`")
    return wide.filter(b.isNotNull() | c.isNotNull()).select(
        "entity",
        b.alias(f"index_{base.suffix}"),
        c.alias(f"index_{current.suffix}"),
        F.when(present, c - b)
        .otherwise(F.raise_error(F.lit("a period is absent from the frame")).cast("double"))
        .alias("change"),
    )
