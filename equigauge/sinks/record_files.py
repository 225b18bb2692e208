"""Fixed-width record files under names of their own.

A file is a header row and its records, written one after the other by one task, so no row holds a
file. Each is closed by a line feed: the header's belongs to its length, a record's is its last
field. Names with many records are split over files ``<name>.p0``, ``<name>.p1`` and so on.
"""

from __future__ import annotations

from typing import NamedTuple
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, functions as F

from equigauge.session import staged
from equigauge.sources.fixed_width import (
    CHARSET, DESCRIPTOR_SIZE, END_OF_FIELDS, HEADER_SIZE, NAME_SIZE, SIZE_AT, TYPE_AT,
)

#: Records of one file, at most about.
FILE_RECORDS = 1_000_000


class Field(NamedTuple):
    name: str
    kind: str  # C text, N number
    size: int


END_OF_LINE = Field("EOL", "C", 1)


def little_endian(value: Column, size: int) -> Column:
    """Bytes of a whole number, the lowest first."""
    digits = F.lpad(F.hex(value), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * (size - i) - 1, 2) for i in range(size)]))


def _descriptor(field: Field) -> bytes:
    out = bytearray(DESCRIPTOR_SIZE)
    name = field.name.encode("ascii")[:NAME_SIZE]
    out[: len(name)] = name
    out[TYPE_AT - 1] = ord(field.kind)
    out[SIZE_AT - 1] = field.size
    return bytes(out)


def header_of(fields: list[Field], records: Column) -> Column:
    """Header bytes without the line feed that ends them."""
    whole = [*fields, END_OF_LINE]
    length = HEADER_SIZE + DESCRIPTOR_SIZE * len(whole) + 2
    described = b"".join(_descriptor(f) for f in whole)
    return F.concat(
        F.lit(b"\x03\x18\x01\x01"),
        little_endian(records, 4),
        little_endian(F.lit(length), 2),
        little_endian(F.lit(1 + sum(f.size for f in whole)), 2),
        F.lit(b"\0" * (HEADER_SIZE - 12) + described + bytes.fromhex(END_OF_FIELDS)),
    )


def record_of(fields: list[Field]) -> Column:
    """Record bytes without the line feed: not deleted, null as blanks, too long values cut."""

    def padded(field: Field) -> Column:
        text = F.coalesce(F.col(field.name).cast("string"), F.lit(""))
        return (F.lpad if field.kind == "N" else F.rpad)(text, field.size, " ")

    return F.encode(F.concat(F.lit(" "), *[padded(f) for f in fields]), CHARSET)


def write_record_files(
    df: DataFrame, path: str, name: str, fields: list[Field], file_records: int = FILE_RECORDS
) -> int:
    """One file or more for every value of column ``name``; returns the number of files.

    Records are made once and staged: files are counted out, headed and filled from those.
    """
    made = df.select(F.col(name).alias("_name"), record_of(fields).alias("_bytes"))
    rows = staged(made, "records")
    parts = rows.groupBy("_name").agg(
        F.greatest(F.ceil(F.count("*") / F.lit(file_records)), F.lit(1)).cast("long").alias("_parts")
    )
    file = F.concat("_name", F.lit(".p"), F.pmod(F.xxhash64("_bytes"), F.col("_parts")).cast("string"))
    # Never null, so that the writer takes the sort below as it is.
    dealt = rows.join(parts, "_name").select(F.coalesce(file, F.lit("")).alias("_file"), "_bytes")
    heads = dealt.groupBy("_file").agg(F.count("*").alias("_n")).select(
        "_file", F.lit(0).alias("_kind"), header_of(fields, F.col("_n")).alias("_bytes")
    )
    whole = dealt.select("_file", F.lit(1).alias("_kind"), "_bytes").unionByName(heads)
    return write_named(whole, path, "_file", "_bytes", "_kind")


def write_named(df: DataFrame, path: str, name: str, value: str, *order: str) -> int:
    """Files under the names of a column, which has no nulls: a row's bytes and a line feed for
    each row. Returns the number of files.

    They are written beside the folder and moved into it at the end; others there stay.
    """
    written = f"{path}.writing"
    (
        df.repartition(name)
        .sortWithinPartitions(name, *order)
        .select(F.col(name).alias("_file"), F.col(value).cast("string").alias("value"))
        .write.partitionBy("_file")
        .text(written)
    )
    return _take_names(df.sparkSession, written, path)


def _take_names(spark, written: str, path: str) -> int:
    """Move ``_file=<name>/part-*`` to ``<path>/<name>``; one rename a file, no data is copied."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    source, target = hadoop.Path(written), hadoop.Path(path)
    system = source.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(target)
    done = 0
    for status in system.globStatus(hadoop.Path(written, "_file=*/part-*")):
        name = unquote(status.getPath().getParent().getName().removeprefix("_file="))
        if not system.rename(status.getPath(), hadoop.Path(target, name)):
            raise OSError(f"{name} could not be moved")
        done += 1
    system.delete(source, True)
    return done
