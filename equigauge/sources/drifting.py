"""Parquet trees whose files have grown columns or wider types over time.

The footers of all files are read where the tasks run, and what comes back to the driver is one row
for each distinct column and type. From those comes one schema: a column that a file lacks is null
in its rows, numbers are widened. The files are then one ordinary scan with that schema, so filters
and column pruning reach it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import (
    ByteType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType,
    StructField, StructType, TimestampNTZType,
)

from equigauge.sources.record_files import opened

_WHOLE = [ByteType(), ShortType(), IntegerType(), LongType()]
#: Decimal digits that hold every value of a whole type.
_DIGITS = {ByteType(): 3, ShortType(): 5, IntegerType(): 10, LongType(): 20}


class IncompatibleTypes(ValueError):
    """Types of one column that no type of the scan can hold."""


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, places, types = [], [], []
        for path in batch.column("path").to_pylist():
            with opened(path) as file:
                schema = pq.read_schema(file)
            for place, field in enumerate(schema):
                names.append(field.name)
                places.append(place)
                types.append(from_arrow_type(field.type, prefer_timestamp_ntz=False).json())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(places, pa.int32()), pa.array(types, pa.string())],
            names=["name", "place", "type"],
        )


def tree_columns(spark: SparkSession, root: str) -> DataFrame:
    """name, type (as JSON), first place and number of files of every column of a tree."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(root)
        .select("path")
    )
    columns = files.mapInArrow(_footers, "name string, place int, type string")
    return columns.groupBy("name", "type").agg(F.min("place").alias("place"), F.count("*").alias("files"))


def wider(name: str, a: DataType, b: DataType) -> DataType:
    """The narrowest type that holds all values of both."""
    if a == b:
        return a
    for one, other in ((a, b), (b, a)):
        if one in _WHOLE and other in _WHOLE:
            return max(a, b, key=_WHOLE.index)
        if isinstance(one, FloatType) and isinstance(other, DoubleType):
            return other
        # A double holds whole numbers of 32 bits; a long may lose digits in it.
        if one in _WHOLE[:3] and isinstance(other, DoubleType):
            return other
        if isinstance(one, DecimalType) and isinstance(other, DecimalType):
            return _decimal(name, (one.precision, one.scale), (other.precision, other.scale))
        if one in _DIGITS and isinstance(other, DecimalType):
            return _decimal(name, (_DIGITS[one], 0), (other.precision, other.scale))
        if isinstance(one, DateType) and isinstance(other, TimestampNTZType):
            return other
    raise IncompatibleTypes(f"column {name} is {a.simpleString()} in some files and {b.simpleString()} in others")


def _decimal(name: str, *types: tuple[int, int]) -> DecimalType:
    scale = max(s for _, s in types)
    digits = max(p - s for p, s in types) + scale
    if digits > 38:
        raise IncompatibleTypes(f"column {name} needs a decimal of {digits} digits")
    return DecimalType(digits, scale)


def tree_schema(spark: SparkSession, root: str) -> StructType:
    """One schema for all files, columns in the order in which the files have them."""
    types: dict[str, DataType] = {}
    rows = tree_columns(spark, root).orderBy("place", "name", "type").collect()
    for row in rows:
        kind = StructField.fromJson(
            {"name": row["name"], "type": json.loads(row["type"]), "nullable": True, "metadata": {}}
        ).dataType
        types[row["name"]] = wider(row["name"], types[row["name"]], kind) if row["name"] in types else kind
    return StructType([StructField(n, t) for n, t in types.items()])


def read_drifting_tree(spark: SparkSession, root: str) -> DataFrame:
    """All rows of a tree with the columns of all its files; keys in the path are columns, too."""
    return spark.read.schema(tree_schema(spark, root)).parquet(root)
