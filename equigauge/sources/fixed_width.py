"""Fixed-width record tables (a binary header, field descriptors, then records).

Each file is one row of a ``binaryFile`` read. The header is read with expressions, chunks of records
are cut out of the file and records out of chunks, and from there on every record is its own small
row.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from equigauge.functions.text import lenient_double, strip

# Layout of the format (fixed values): 1-based byte positions and sizes.
HEADER_SIZE = 32
COUNT_AT, COUNT_SIZE = 5, 4
HEADER_LENGTH_AT, RECORD_LENGTH_AT, LENGTH_SIZE = 9, 11, 2
DESCRIPTOR_SIZE = 32
NAME_SIZE, TYPE_AT, SIZE_AT = 11, 12, 17
END_OF_FIELDS = "0D"
DELETED = "2A"
CHARSET = "ISO-8859-1"

NUMERIC_TYPES = ("N", "F")

TEXT, NUMBER = "text", "number"
#: Records that are cut out of a file at once.
CHUNK = 10_000


def _bytes(content: Column, at, size) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.substring(content, as_col(at), as_col(size))


def _little_endian(content: Column, at, size: int) -> Column:
    value = F.lit(0).cast("long")
    for i in range(size):
        byte = F.conv(F.hex(_bytes(content, at + i, 1)), 16, 10).cast("long")
        value = value + byte * F.lit(256**i)
    return value


FIELD = "struct<name: string, type: string, at: int, size: int>"


def _fields(content: Column, header_length: Column) -> Column:
    """Field list with 1-based offsets inside the record, in one pass; it ends at the end mark."""
    slots = F.floor((header_length - F.lit(HEADER_SIZE)) / F.lit(DESCRIPTOR_SIZE)).cast("int")
    spots = F.when(
        slots > 0,
        F.transform(
            F.sequence(F.lit(0), slots - 1),
            lambda k: F.lit(HEADER_SIZE + 1) + k * F.lit(DESCRIPTOR_SIZE),
        ),
    ).otherwise(F.array().cast("array<int>"))

    def take(state: Column, start: Column) -> Column:
        name = F.decode(_bytes(content, start, NAME_SIZE), CHARSET)
        size = F.conv(F.hex(_bytes(content, start + F.lit(SIZE_AT - 1), 1)), 16, 10).cast("int")
        field = F.struct(
            F.split_part(name, F.lit("\0"), F.lit(1)).alias("name"),
            F.decode(_bytes(content, start + F.lit(TYPE_AT - 1), 1), CHARSET).alias("type"),
            state["at"].alias("at"),
            size.alias("size"),
        )
        ended = state["ended"] | (F.hex(_bytes(content, start, 1)) == END_OF_FIELDS)
        return F.struct(
            F.when(ended, state["at"]).otherwise(state["at"] + size).alias("at"),
            F.when(ended, state["out"])
            .otherwise(F.array_append(state["out"], field))
            .alias("out"),
            ended.alias("ended"),
        )

    # The first byte of a record is its deletion mark, so fields start at the second.
    start = F.struct(
        F.lit(2).alias("at"),
        F.array().cast(f"array<{FIELD}>").alias("out"),
        F.lit(False).alias("ended"),
    )
    return F.aggregate(spots, start, take, lambda state: state["out"])


def file_headers(files: DataFrame) -> DataFrame:
    """(path, content) rows with their header, field list and a status; bad files stay, marked.

    Where there is a ``length``, it is that of the file and the content only its beginning.
    """
    content = F.col("content")
    length = F.col("length") if "length" in files.columns else F.octet_length(content)
    readable = length >= HEADER_SIZE
    declared = F.when(readable, _little_endian(content, COUNT_AT, COUNT_SIZE))
    header_length = F.when(readable, _little_endian(content, HEADER_LENGTH_AT, LENGTH_SIZE))
    record_length = F.when(readable, _little_endian(content, RECORD_LENGTH_AT, LENGTH_SIZE))
    status = (
        F.when(~F.coalesce(readable, F.lit(False)), F.lit("truncated header"))
        .when(F.col("record_length") < 1, F.lit("bad record length"))
        .when(F.col("header_length") < HEADER_SIZE, F.lit("bad header length"))
        .otherwise(F.lit("ok"))
    )
    return (
        files.withColumns(
            {
                "declared": declared,
                "header_length": header_length,
                "record_length": record_length,
            }
        )
        .withColumn("status", status)
        .withColumn(
            # Some files declare more records than they hold.
            "records",
            F.when(
                F.col("status") == "ok",
                F.greatest(
                    F.least(
                        F.col("declared"),
                        F.floor((length - F.col("header_length")) / F.col("record_length")),
                    ),
                    F.lit(0),
                ),
            ).otherwise(F.lit(0)),
        )
        .withColumn(
            "fields",
            F.when(F.col("status") == "ok", _fields(content, F.col("header_length"))),
        )
    )


def header_columns(files: DataFrame) -> dict[str, str]:
    """All fields of all headers, in the order of their places, with the type they are declared as.

    A field that is numeric (types N and F) in every file is a number; all others are text.
    """
    named = file_headers(files).filter("status = 'ok'").select(F.explode("fields").alias("field"))
    found = named.groupBy("field.name").agg(
        F.bool_and(F.col("field.type").isin(*NUMERIC_TYPES)).alias("number"),
        F.min("field.at").alias("at"),
    )
    return {
        r["name"]: NUMBER if r["number"] else TEXT for r in found.orderBy("at", "name").collect()
    }


def decode_files(files: DataFrame, columns: Mapping[str, str] | None = None) -> DataFrame:
    """Records of all files with the wanted columns, as text or numbers; without any, all columns.

    Deleted records are dropped. A column a file does not have is null. ``columns`` says which type
    the result has, or else the headers do. Files are cut into chunks of ``CHUNK`` records first,
    each a row of its own, and chunks into records.
    """
    columns = header_columns(files) if columns is None else columns
    heads = file_headers(files).filter("status = 'ok' AND records > 0")
    chunk = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("records") - 1, F.lit(CHUNK).cast("long")),
        lambda i: _bytes(
            F.col("content"),
            (F.col("header_length") + i * F.col("record_length") + 1).cast("int"),
            (F.least(F.lit(CHUNK), F.col("records") - i) * F.col("record_length")).cast("int"),
        ),
    )
    chunks = heads.select(
        "path", "record_length", *wanted_fields(columns), F.explode(chunk).alias("_chunk")
    )
    return decode_chunks(chunks, columns, ["path"])


def wanted_fields(columns: Mapping[str, str]) -> list[Column]:
    """The wanted fields of a header, so that rows carry two numbers per column, not the header."""
    place = lambda field: F.when(field.isNotNull(), F.struct(field["at"].alias("at"), field["size"].alias("size")))
    return [place(_field_named(name)).alias(f"_{name}") for name in columns]


def decode_chunks(
    chunks: DataFrame, columns: Mapping[str, str], keep: Sequence[str] = ()
) -> DataFrame:
    """Rows of records from runs of whole records (``_chunk``); deleted records are dropped.

    Values are projections of a record's bytes, so a column that nobody selects is never decoded.
    """
    size = F.col("record_length").cast("int")
    cut = F.transform(
        F.sequence(F.lit(1), F.octet_length("_chunk") - size + 1, size),
        lambda at: _bytes(F.col("_chunk"), at, size),
    )
    records = chunks.select(
        *keep, *[f"_{name}" for name in columns], F.explode(cut).alias("_record")
    ).filter(_bytes(F.col("_record"), 1, 1) != F.lit(bytes.fromhex(DELETED)))
    return records.select(*keep, *[_value(name, kind).alias(name) for name, kind in columns.items()])


def _field_named(name: str) -> Column:
    hits = F.filter(F.col("fields"), lambda f: f["name"] == F.lit(name))
    return F.try_element_at(hits, F.lit(1))


def _value(name: str, kind: str) -> Column:
    field = F.col(f"_{name}")
    raw = _bytes(F.col("_record"), field["at"], field["size"])
    # Text fields may be filled up with zero bytes.
    text = F.replace(F.decode(raw, CHARSET), F.lit("\0"), F.lit(""))
    return lenient_double(text) if kind == NUMBER else strip(text)


def read_fixed_width(
    spark: SparkSession, path: str, columns: Mapping[str, str] | None = None
) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return decode_files(files, columns)
