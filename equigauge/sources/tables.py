"""Parquet trees, delimited files and SQL text files."""

from __future__ import annotations

from pathlib import Path
from typing import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from equigauge.functions.text import locale_double, strip
from equigauge.session import staged


def read_tree(spark: SparkSession, root: str, path_keys: bool = True) -> DataFrame:
    """A partitioned parquet tree. Values in the path win over columns of the same name;
    ``path_keys=False`` reads the files alone, path values left out."""
    if path_keys:
        return spark.read.parquet(root)
    return spark.read.option("recursiveFileLookup", "true").parquet(root)


def read_csv(spark: SparkSession, path: str, schema: str, columns=None) -> DataFrame:
    """A headed CSV with pinned types, so codes keep their leading zeros."""
    df = spark.read.schema(schema).option("header", "true").option("enforceSchema", "false").csv(
        path
    )
    return df.select(*columns) if columns else df


def parse_locale(df: DataFrame, numbers: Mapping[str, str]) -> DataFrame:
    """Turn decimal-comma text columns into the given types."""
    return df.withColumns(
        {name: _typed(locale_double(F.col(name)), kind) for name, kind in numbers.items()}
    )


def _typed(number: Column, kind: str) -> Column:
    return number if kind == "double" else number.try_cast(kind)


def read_locale_csv(
    spark: SparkSession, path: str, columns: list[str], numbers: Mapping[str, str]
) -> DataFrame:
    """A ``;`` separated file with decimal commas and a byte-order mark.

    The columns are read by position, so the header must name the wanted ones in their order.
    One file's header is checked here, that of every other file when it is read.
    """
    first = spark.read.text(path).head(1)
    found = [n.strip('"') for n in first[0][0].lstrip("\ufeff").split(";")] if first else columns
    if found != list(columns):
        raise ValueError(f"columns {found} where {list(columns)} are wanted")
    schema = ", ".join(f"`{c}` string" for c in columns)
    raw = (
        spark.read.schema(schema)
        .option("sep", ";")
        .option("header", "true")
        .option("enforceSchema", "false")
        .option("nullValue", "")
        .csv(path)
    )
    return parse_locale(raw, numbers)


CORRUPT = "_corrupt_record"
REJECTS = "path string, category string, record string"
MALFORMED, UNREADABLE = "malformed record", "unreadable number"


def split_csv(
    spark: SparkSession, path: str, schema: str, sep: str = ",", stage=staged
) -> tuple[DataFrame, DataFrame]:
    """A headed CSV as good rows and rejects (path, category, record), from one read.

    A record with too few or too many fields, or with a field that is not of its type, is a reject
    as a whole. Every file's header is checked. All fields are parsed, also those that a caller
    selects away, or else a record's faults would depend on who reads it.
    """
    parsed = stage(_permissive(spark, path, schema, sep).withColumn(_PATH, F.col("_metadata.file_path")), "csv")
    rejects = parsed.filter(F.col(CORRUPT).isNotNull()).select(
        F.col(_PATH).alias("path"), F.lit(MALFORMED).alias("category"), F.col(CORRUPT).alias("record")
    )
    return parsed.filter(F.col(CORRUPT).isNull()).drop(CORRUPT, _PATH), rejects


_PATH = "_path"


def _permissive(spark: SparkSession, path: str, schema: str, sep: str) -> DataFrame:
    return (
        spark.read.schema(f"{schema}, {CORRUPT} string")
        .option("sep", sep)
        .option("header", "true")
        .option("enforceSchema", "false")
        .option("columnPruning", "false")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .csv(path)
    )


def split_locale_csv(
    spark: SparkSession, path: str, columns: list[str], numbers: Mapping[str, str], stage=staged
) -> tuple[DataFrame, DataFrame]:
    """`read_locale_csv` as good rows and rejects.

    A record with another number of fields is malformed; one with a number that is none, though
    it is not empty, is unreadable. A first column's byte-order mark belongs to its name.
    """
    texts = ", ".join(f"`{c}` string" for c in columns)
    raw = stage(_permissive(spark, path, texts, ";").withColumn(_PATH, F.col("_metadata.file_path")), "csv")
    typed = parse_locale(raw.withColumns({f"_{n}": F.col(n) for n in numbers}), numbers)
    unread = F.lit(False)
    for name in numbers:
        unread = unread | (F.col(name).isNull() & (F.coalesce(strip(F.col(f"_{name}")), F.lit("")) != ""))
    told = typed.withColumn(
        "_category", F.when(F.col(CORRUPT).isNotNull(), F.lit(MALFORMED)).when(unread, F.lit(UNREADABLE))
    )
    line = F.concat_ws(";", *[F.coalesce(F.col(f"_{c}" if c in numbers else c), F.lit("")) for c in columns])
    rejects = told.filter(F.col("_category").isNotNull()).select(
        F.col(_PATH).alias("path"), F.col("_category").alias("category"), F.coalesce(CORRUPT, line).alias("record")
    )
    return told.filter(F.col("_category").isNull()).select(*columns), rejects


def sql_statements(path: str | Path) -> list[str]:
    """The statements of a small SQL file, in order, for ``spark.sql``."""
    text = Path(path).read_text(encoding="utf-8")
    return [s.strip() for s in text.split(";") if s.strip()]
