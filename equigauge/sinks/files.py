"""Parquet, CSV and locale CSV writers. Spark's commit protocol makes each write atomic."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

BYTE_ORDER_MARK = "﻿"


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_partitioned(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """One folder per key value; folders of values that are written again are replaced.

    So a repeated run leaves no row twice. The incoming partitioning is kept, so a value that
    holds most rows is still written by many tasks.
    """
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*keys).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def decimal_comma(col: Column) -> Column:
    """A double in plain notation with a decimal comma, with every digit that it has."""
    text = col.cast("string")
    number = F.when(F.contains(text, F.lit("E")), plain_notation(text)).otherwise(text)
    return F.replace(number, F.lit("."), F.lit(","))


def plain_notation(text: Column) -> Column:
    """``d.dddE±x`` without its exponent: the point is moved through the digits."""
    parts = lambda group: F.regexp_extract(text, r"^(-?)(\d+)\.(\d+)E(-?\d+)$", group)
    sign, lead, tail = parts(1), parts(2), F.regexp_replace(parts(3), "0+$", "")
    digits = F.concat(lead, tail)
    point = F.length(lead) + parts(4).try_cast("int")
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)
    large = F.concat(digits, F.repeat(F.lit("0"), point - F.length(digits)), F.lit(".0"))
    inside = F.concat(
        F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, F.length(digits))
    )
    moved = F.when(point <= 0, small).when(point >= F.length(digits), large).otherwise(inside)
    return F.concat(sign, moved)


def locale_columns(df: DataFrame) -> DataFrame:
    """Fractions as decimal-comma text; booleans as True/False; other columns unchanged."""
    out = []
    for field in df.schema.fields:
        col = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            col = decimal_comma(col.cast("double"))
        elif isinstance(field.dataType, T.BooleanType):
            col = F.when(col, F.lit("True")).when(~col, F.lit("False"))
        out.append(col.alias(field.name))
    return df.select(*out)


def write_locale_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    """``;`` separated, decimal comma, UTF-8 with a byte-order mark at the start of each file.

    Compressed files carry the codec in their names, and Spark's readers open them as they are.
    """
    text = locale_columns(df)
    first, *rest = text.columns
    marked = text.select(F.col(first).alias(BYTE_ORDER_MARK + first), *rest)
    (
        marked.write.mode("overwrite")
        .option("sep", ";")
        .option("header", "true")
        .option("nullValue", "")
        .option("emptyValue", "")
        .option("compression", compression)
        .csv(path)
    )
