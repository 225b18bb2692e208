"""Folders of fixed-width record files of any size, read by ranges of whole records.

A listing names the files without opening them. Their headers (a few hundred bytes each) are read
in parallel and cut every file into ranges of records; a range is one ranged read, by whichever
task has it, so one file is read by many tasks and nothing of a file but one piece is in memory.
What comes out of a read are bytes; records and values are cut out of them by expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import AbstractContextManager
from typing import BinaryIO, Callable, Mapping, Sequence
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from equigauge.session import staged
from equigauge.sources.fixed_width import (
    HEADER_LENGTH_AT, HEADER_SIZE, LENGTH_SIZE, decode_chunks, file_headers, header_columns,
    wanted_fields,
)

#: Columns of a binary file source, which streams need to be told.
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
#: A range is about this long, and so is what one task reads.
RANGE_BYTES = 64 << 20
#: A range comes out in pieces of about this size, each a row; small ones share a batch of it.
PIECE_BYTES = 1 << 20
#: What records get from their file.
KEPT = ("path", "name")


def opened(path: str) -> AbstractContextManager[BinaryIO]:
    """A file opened where the task runs, by the scheme of its path."""
    scheme = urlsplit(path).scheme
    if scheme in ("", "file"):
        return open(path.removeprefix("file:"), "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def listed(files: DataFrame) -> DataFrame:
    """path, length and name of a binary file source, batch or stream; contents are not read."""
    return files.select("path", "length", F.col("_metadata.file_name").alias("name"))


def list_record_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return listed(reader.load(path))


def _first_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        heads = []
        for path in batch.column("path").to_pylist():
            with opened(path) as file:
                head = file.read(HEADER_SIZE)
                if len(head) == HEADER_SIZE:
                    at = HEADER_LENGTH_AT - 1
                    length = int.from_bytes(head[at : at + LENGTH_SIZE], "little")
                    head += file.read(max(length - HEADER_SIZE, 0))
            heads.append(head)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(heads, pa.binary())], names=[*batch.schema.names, "content"]
        )


def read_headers(files: DataFrame) -> DataFrame:
    """Listed files with header, field list, number of records and a status."""
    schema = StructType([*files.schema.fields, StructField("content", BinaryType())])
    return file_headers(files.mapInArrow(_first_bytes, schema))


def record_ranges(
    headers: DataFrame,
    columns: Mapping[str, str],
    range_bytes: int = RANGE_BYTES,
    keep: Sequence[str] = KEPT,
) -> DataFrame:
    """A row for each range of records: where it starts in its file, and its length."""
    size = F.col("record_length")
    each = F.greatest(F.floor(F.lit(range_bytes) / size), F.lit(1)).cast("long")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1, each))
    return (
        headers.filter("status = 'ok' AND records > 0")
        .select(
            *keep, "header_length", "record_length", "records",
            each.alias("_each"), *wanted_fields(columns), starts.alias("_first"),
        )
        .withColumn("at", F.col("header_length") + F.col("_first") * size)
        .withColumn("size", F.least("_each", F.col("records") - F.col("_first")) * size)
        .drop("header_length", "records", "_each", "_first")
    )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = zip(*(batch.column(c).to_pylist() for c in ("path", "at", "size", "record_length")))
        rows, held, length = [], [], 0
        for row, (path, at, size, record) in enumerate(spans):
            piece = max(PIECE_BYTES // record, 1) * record
            with opened(path) as file:
                file.seek(at)
                for start in range(0, size, piece):
                    data = file.read(min(piece, size - start))
                    if len(data) != min(piece, size - start):
                        raise OSError(f"{path} is shorter than when it was listed")
                    rows.append(row)
                    held.append(data)
                    length += len(data)
                    if length >= PIECE_BYTES:
                        yield _with_chunks(batch, rows, held)
                        rows, held, length = [], [], 0
        if rows:
            yield _with_chunks(batch, rows, held)


def _with_chunks(batch: pa.RecordBatch, rows: list[int], chunks: list[bytes]) -> pa.RecordBatch:
    own = batch.take(pa.array(rows))
    return pa.RecordBatch.from_arrays(
        [*own.columns, pa.array(chunks, pa.binary())], names=[*own.schema.names, "_chunk"]
    )


def read_ranges(
    headers: DataFrame,
    columns: Mapping[str, str],
    range_bytes: int = RANGE_BYTES,
    stage: Callable[[DataFrame, str], DataFrame] = staged,
    keep: Sequence[str] = KEPT,
) -> DataFrame | None:
    """Columns of the file to keep and the wanted ones of all records; None where no file has any."""
    spark = headers.sparkSession
    ranges = stage(record_ranges(headers, columns, range_bytes, keep), "record-ranges")
    n, size = ranges.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if n == 0:
        return None
    # A stated number of tasks: by the bytes of their rows, ranges would all go to one.
    tasks = min(n, max(-(-size // RANGE_BYTES), spark.sparkContext.defaultParallelism))
    schema = StructType([*ranges.schema.fields, StructField("_chunk", BinaryType())])
    pieces = ranges.repartition(int(tasks)).mapInArrow(_pieces, schema)
    return decode_chunks(pieces, columns, keep)


def read_record_files(
    spark: SparkSession,
    path: str,
    columns: Mapping[str, str] | None = None,
    range_bytes: int = RANGE_BYTES,
    of_file: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Records of all files below a folder; files without a sound header are left out.

    Without ``columns``, all columns of all headers. ``of_file`` are expressions over path and name
    that are computed once a file and kept with its records.
    """
    files = list_record_files(spark, path)
    headers = staged(read_headers(files).withColumns(dict(of_file or {})), "record-headers")
    keep = [*KEPT, *(of_file or {})]
    if columns is None:
        columns = header_columns(headers.select("path", "length", "content"))
    records = read_ranges(headers, columns, range_bytes, keep=keep)
    if records is None:
        kinds = ", ".join(f"`{c}` {'double' if k == 'number' else 'string'}" for c, k in columns.items())
        files_own = ", ".join(f"`{c}` {headers.schema[c].dataType.simpleString()}" for c in keep)
        return spark.createDataFrame([], f"{files_own}, {kinds}")
    return records
