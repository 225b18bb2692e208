"""Checks that stop a pipeline error from becoming a finding."""

from __future__ import annotations

from functools import reduce
from operator import add
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from equigauge.config import RANGE_LIMITS, Bands
from equigauge.functions.numeric import ratio
from equigauge.functions.text import nan_to_null, strip


def completeness_of(
    expected: DataFrame, processed: DataFrame, keys: Sequence[str], tolerance: float = 0.02
) -> DataFrame:
    """`completeness` of two key sets held as frames, as one row.

    Counts the distinct inputs of either side; see `missing_inputs` for which are absent.
    """
    n = lambda df: df.select(*keys).distinct().agg(F.count("*")).scalar()
    one = expected.sparkSession.range(1).select(
        n(expected).alias("expected"), n(processed).alias("processed")
    )
    missing = F.col("expected") - F.col("processed")
    return one.select(
        "expected",
        "processed",
        missing.alias("missing"),
        F.coalesce(ratio(missing, F.col("expected")), F.lit(0.0)).alias("missing_share"),
        (missing <= F.col("expected") * F.lit(tolerance)).alias("passed"),
    )


def expected_files(
    spark: SparkSession, states: Sequence[str], years: Sequence[int], months: Sequence[int] = range(1, 13)
) -> DataFrame:
    """state, year and month of every file that there should be, made of literal lists."""
    each = lambda values, kind: F.explode(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"))
    return (
        spark.range(1)
        .select(each(states, "string").alias("state"))
        .select("state", each(years, "int").alias("year"))
        .select("state", "year", each(months, "int").alias("month"))
    )


def missing_inputs(expected: DataFrame, processed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return expected.join(processed.select(*keys).distinct(), list(keys), "left_anti")


def orphan_denominators(df: DataFrame) -> DataFrame:
    """Rows with cases whose population is null, unreadable, zero or negative."""
    population = nan_to_null(F.col("population"))
    return df.filter(
        (F.col("cases") > 0) & (population.isNull() | (population <= 0))
    )


def range_violations(df: DataFrame, limits: Mapping = RANGE_LIMITS) -> DataFrame:
    """(position, measure, below, above) for each limited column the frame has; one pass."""
    present = [(c, lo, hi) for c, (lo, hi) in limits.items() if c in df.columns]
    if not present:
        raise ValueError("the frame has none of the limited measures")
    sums = []
    for c, low, high in present:
        x = nan_to_null(F.col(c))
        below = F.count_if(x < F.lit(low)) if low is not None else F.lit(0).cast("long")
        above = F.count_if(x > F.lit(high)) if high is not None else F.lit(0).cast("long")
        sums += [below.alias(f"{c}_below"), above.alias(f"{c}_above")]
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(c).alias("measure"),
            F.col(f"{c}_below").alias("below"),
            F.col(f"{c}_above").alias("above"),
        )
        for i, (c, _, _) in enumerate(present, start=1)
    ]
    return df.agg(F.count("*").alias("_rows"), *sums).select(F.inline(F.array(*rows)))


def check_ranges(df: DataFrame, limits: Mapping = RANGE_LIMITS) -> DataFrame:
    """Raise on the first measure (in limit order) that leaves its range."""
    bad = (
        range_violations(df, limits)
        .filter("below > 0 OR above > 0")
        .orderBy("position")
        .limit(1)
        .collect()
    )
    if bad:
        low, high = limits[bad[0]["measure"]]
        side = f"below {low}" if bad[0]["below"] else f"above {high}"
        raise ValueError(f"{bad[0]['measure']} has a value {side}")
    return df


def reconcile(
    ours: DataFrame,
    external: DataFrame,
    keys: Sequence[str] = ("state", "year"),
    measure: str = "cases",
    tolerance: float = 0.02,
) -> DataFrame:
    """Full outer comparison of totals. A key on one side only stays, and fails."""
    left = ours.select(*keys, F.col(measure).alias(f"{measure}_ours"))
    right = external.select(*keys, F.col(measure).alias(f"{measure}_external"))
    difference = F.col(f"{measure}_ours") - F.col(f"{measure}_external")
    error = ratio(F.abs(difference), F.col(f"{measure}_external"))
    return left.join(right, list(keys), "full_outer").select(
        *keys,
        f"{measure}_ours",
        f"{measure}_external",
        difference.alias("difference"),
        error.alias("relative_error"),
        F.coalesce(error <= F.lit(tolerance), F.lit(False)).alias("passed"),
    )


def orphan_key_share(df: DataFrame, key: str = "entity", limit: float = 0.01) -> DataFrame:
    """Share of rows whose key found no match, and whether it stays below the limit."""
    share = F.coalesce(F.avg(F.col(key).isNull().cast("double")), F.lit(0.0))
    return df.agg(
        F.count("*").alias("rows"), F.count_if(F.col(key).isNull()).alias("orphans"),
        share.alias("share"),
    ).withColumn("passed", F.col("share") < F.lit(limit))


def loss_account(
    silver: DataFrame, sex_codes: Sequence[str], entity: str = "entity"
) -> DataFrame:
    """Where events are lost on the way to the grid, each reason on its own; one pass.

    ``silver`` has the raw sex code, the (possibly null) entity and band, and ``cases``.
    """
    bad_sex = F.col("sex").isNotNull() & ~strip(F.col("sex")).isin(*sex_codes)
    no_sex = F.col("sex").isNull() | bad_sex
    lost = F.col(entity).isNull() | F.col("band").isNull() | no_sex
    cases_if = lambda cond: F.coalesce(
        F.sum(F.when(cond, F.col("cases"))), F.lit(0)
    ).cast("long")
    return silver.agg(
        F.coalesce(F.sum("cases"), F.lit(0)).cast("long").alias("cases"),
        F.count_if(F.col(entity).isNull()).alias("rows_without_entity"),
        F.count_if(bad_sex).alias("rows_with_other_sex"),
        cases_if(F.col(entity).isNull()).alias("cases_without_entity"),
        cases_if(no_sex).alias("cases_without_sex"),
        cases_if(F.col("band").isNull()).alias("cases_without_band"),
        cases_if(lost).alias("cases_outside_grid"),
    )


def export_checks(
    source: DataFrame, exported: DataFrame, entities: DataFrame, measure: str = "cases"
) -> DataFrame:
    """Totals before and after the export, and entities left without a name, as one row."""
    total = lambda df: df.agg(F.sum(measure).cast("long")).scalar()
    unnamed = entities.agg(F.count_if(F.col("name").isNull())).scalar()
    one = source.sparkSession.range(1).select(
        total(source).alias("source_total"),
        total(exported).alias("exported_total"),
        unnamed.alias("unnamed_entities"),
    )
    return one.withColumn(
        "passed",
        (F.col("source_total") == F.col("exported_total")) & (F.col("unnamed_entities") == 0),
    )


def check_export(checks: DataFrame) -> None:
    row = checks.first()
    if not row["passed"]:
        raise ValueError(f"export does not match its source: {row.asDict()}")


def population_contract(
    population: DataFrame,
    bands: Bands,
    sexes: Sequence[str],
    key_length: int,
    regions: int,
    expected_total: int | None = None,
    tolerance: float = 0.005,
) -> DataFrame:
    """(rule, violations) rows for a population table; all rules in one aggregation."""
    total = F.coalesce(F.sum("population"), F.lit(0))
    off = lambda cond: F.when(cond, F.lit(0)).otherwise(F.lit(1)).cast("long")
    # Flags per known value: several distinct counts at once would multiply the rows.
    absent = lambda name, values: reduce(
        add,
        [off(F.coalesce(F.bool_or(F.col(name) == v), F.lit(False))) for v in values],
    )
    rules: dict[str, Column] = {
        "key_length": F.count_if(~F.coalesce(F.length("entity") == key_length, F.lit(False))),
        "unknown_band": F.count_if(~F.coalesce(F.col("band").isin(*bands.labels), F.lit(False))),
        "missing_band": absent("band", bands.labels),
        "unknown_sex": F.count_if(~F.coalesce(F.col("sex").isin(*sexes), F.lit(False))),
        "missing_sex": absent("sex", sexes),
        "negative": F.count_if(F.col("population") < 0),
        "regions": off(F.countDistinct("region") == regions),
    }
    if expected_total is not None:
        rules["total"] = off(
            F.abs(total - F.lit(expected_total)) <= F.lit(expected_total * tolerance)
        )
    sums = population.agg(*[c.alias(name) for name, c in rules.items()])
    return sums.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(name).alias("rule"), F.col(name).alias("violations"))
                    for name in rules
                ]
            )
        )
    )


def reject_gate(rejects: DataFrame, limit: int = 60) -> DataFrame:
    """Raise when rejected inputs reach the limit; counting stops there."""
    if rejects.limit(limit).count() >= limit:
        raise ValueError(f"{limit} or more inputs were rejected")
    return rejects


def reject_summary(decoded: DataFrame, limit: int = 60) -> DataFrame:
    """Rejected inputs by category, with the verdict of the gate on their total."""
    by_category = (
        decoded.filter(F.col("status") != "ok")
        .groupBy(F.col("status").alias("category"))
        .agg(F.count("*").alias("files"))
    )
    total = decoded.agg(F.count_if(F.col("status") != "ok")).scalar()
    return by_category.withColumn("aborted", total >= F.lit(limit))
