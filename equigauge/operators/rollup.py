"""Bronze to silver: admission rows to additive measures per cell."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from equigauge.functions.codes import look_up
from equigauge.functions.numeric import money_sum
from equigauge.functions.text import strip
from equigauge.operators import CELL, MEASURES

SILVER_KEYS = ("code", "year", "sex", "band")


def roll_up(bronze: DataFrame, keys: Sequence[str] = SILVER_KEYS) -> DataFrame:
    """One row per key with counts and sums. Combines on the map side before the shuffle."""
    return bronze.groupBy(*keys).agg(
        F.count("*").alias("cases"),
        F.sum(F.col("severe").cast("long")).alias("severe"),
        F.sum(F.col("death").cast("long")).alias("deaths"),
        money_sum("cost").alias("cost"),
        F.sum(F.col("stay_days").cast("long")).alias("stay_days"),
        F.sum("age_years").alias("age_sum"),
        F.count("age_years").alias("age_known"),
    )


def code_lookup(
    entities: DataFrame, length: int, attributes: Sequence[str] = ()
) -> DataFrame:
    """Short code -> full entity code and its attributes, from one row per entity.

    See `duplicate_codes` for the check that short codes are unique.
    """
    short = F.substring(strip(F.col("entity")), 1, length)
    return entities.select(short.alias("code"), "entity", *attributes)


def duplicate_codes(lookup: DataFrame) -> DataFrame:
    """Short codes that stand for more than one entity; must be empty."""
    return lookup.groupBy("code").agg(F.count("*").alias("n")).filter("n > 1")


def expand_code(df: DataFrame, lookup: DataFrame) -> DataFrame:
    """Add the full entity code; unmatched codes keep their rows with a null entity.

    A short code that stands for more than one entity would multiply cases, so it raises. The
    look-up grows with the number of entities, so its join strategy is left to the size checks of
    the planner; the count of a code uses the partitioning of that join.
    """
    counted = lookup.withColumn("_sharing", F.count("*").over(Window.partitionBy("code")))
    joined = df.withColumn("code", strip(F.col("code"))).join(counted, "code", "left")
    refused = F.raise_error(F.concat(F.lit("code of several entities: "), F.col("code")))
    return joined.withColumn(
        "entity", F.when(F.col("_sharing") > 1, refused.cast("string")).otherwise(F.col("entity"))
    ).drop("_sharing")


def label_sex(df: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Raw sex codes to labels; other codes become null."""
    return df.withColumn("sex", look_up(strip(F.col("sex")), labels))


def merge_cells(
    df: DataFrame, keys: Sequence[str] = CELL, measures: Sequence[str] = MEASURES
) -> DataFrame:
    """Drop rows without a complete key and add up cells that now share one."""
    return (
        df.dropna(subset=list(keys))
        .groupBy(*keys)
        .agg(*[F.sum(m).alias(m) for m in measures])
    )


def first_attributes(df: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """One known value per key for columns that should not vary within it; nulls are passed over.

    Rows first shrink to the distinct combinations by hashing, so that the smallest text of each
    column is sought among a few rows per key. The shuffle by the key that comes next anyway is
    asked for in between: the optimizer would drop a distinct right below a minimum, and every row
    would be sorted.
    """
    few = df.select(key, *names).distinct().repartition(key)
    return few.groupBy(key).agg(*[F.min(n).alias(n) for n in names])
