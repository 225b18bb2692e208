"""Admission records to the cleaned, cohort-only layer. Stateless, so it also runs on streams."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from equigauge.config import Study
from equigauge.functions.age import age_in_years, band_of
from equigauge.functions.codes import has_padded_prefix, has_prefix
from equigauge.functions.text import number_of

# Column names of a raw admission record (fixed values).
RAW_COLUMNS = (
    "MUNIC_RES", "SEXO", "IDADE", "COD_IDADE", "DIAG_PRINC",
    "PROC_REA", "IDENT", "MORTE", "VAL_TOT", "DIAS_PERM",
)
BRONZE_COLUMNS = (
    "code", "sex", "age_years", "band", "year", "month", "severe", "death", "cost", "stay_days",
)


def drop_continuations(df: DataFrame, column: str = "IDENT", code: int = 5) -> DataFrame:
    """Keep every row except continuations; null and unreadable values are kept."""
    return df.filter(~number_of(df, column).eqNullSafe(F.lit(float(code))))


def select_cohort(df: DataFrame, study: Study) -> DataFrame:
    """New admissions of the cohort, with the severe-procedure flag."""
    return (
        drop_continuations(df, "IDENT", study.continuation_code)
        .filter(has_prefix(F.col("DIAG_PRINC"), study.cohort_prefixes))
        .withColumn(
            "severe",
            has_padded_prefix(F.col("PROC_REA"), study.severe_prefix, study.procedure_width),
        )
    )


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns whose expressions the optimizer will not copy into later filters.

    A filter on something derived (a band that is not null) is otherwise pushed below the
    projection with the whole parsing expression written out once per use, which can outgrow what
    code generation accepts. A one-row generator stops exactly that push and nothing else.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def keep_present(df: DataFrame, names) -> DataFrame:
    """Project to the named columns, leaving out those the frame does not have."""
    return df.select(*[n for n in names if n in df.columns])


def with_absent(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Add the named columns that the frame does not have, as null texts."""
    absent = {n: F.lit(None).cast("string") for n in names if n not in df.columns}
    return df.withColumns(absent) if absent else df


def to_bronze(df: DataFrame, study: Study) -> DataFrame:
    """Cohort filter, derived age columns, and the layer schema. ``df`` also has year and month.

    A raw column that the records do not have is null, but the cohort can't be told without the
    diagnosis, so that one is asked for.
    """
    if "DIAG_PRINC" not in df.columns:
        raise ValueError("the records have no DIAG_PRINC, so no cohort can be selected")
    df = with_absent(df, RAW_COLUMNS)
    parsed = compute_once(
        select_cohort(df, study),
        _age=number_of(df, "IDADE"),
        _age_unit=number_of(df, "COD_IDADE"),
    )
    age = age_in_years(F.col("_age"), F.col("_age_unit"))
    return (
        compute_once(parsed, age_years=age)
        .select(
            F.col("MUNIC_RES").alias("code"),
            F.col("SEXO").alias("sex"),
            "age_years",
            band_of(F.col("age_years"), study.bands).alias("band"),
            F.col("year").cast("int").alias("year"),
            F.col("month").cast("int").alias("month"),
            "severe",
            F.col("MORTE").cast("int").alias("death"),
            F.col("VAL_TOT").cast("double").alias("cost"),
            F.col("DIAS_PERM").cast("int").alias("stay_days"),
        )
    )
