"""Helpers that several training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equigauge.session import delete_folder, stage_path, swept

#: White space that separates words: space, tab, line feed, vertical tab, form feed, return.
BLANK = r"[\x20\x09-\x0D]+"
#: A word: the longest run without such white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Batches between Spark and Python. A task holds a few at a time, and texts may be very long.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}


def prepare(spark: SparkSession) -> SparkSession:
    """The session, with the batch sizes that the operators' memory is reckoned for."""
    for name, value in BATCHES.items():
        spark.conf.set(name, value)
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read with a prepared session."""
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def drawn(df: DataFrame, key: str, rows: int) -> DataFrame:
    """A bounded sample, at most ``rows`` rows: those with the least hash of ``key``, then by key.

    Rows whose hash can't be among the least are left out first, so that tasks have few to offer.
    """
    n = df.count()
    share = min(1.0, (1.2 * rows + 1000) / max(n, 1))
    slot = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    return df.filter(slot <= F.lit(int(share * (1 << 40)))).orderBy(slot, key).limit(rows)


def staged(df: DataFrame, label: str) -> DataFrame:
    """The same rows, read back from a table written once to the shared folder, well compressed."""
    spark = df.sparkSession
    path = stage_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Stages:
    """Staged tables of one query, each deleted as soon as no later step reads it.

    Shuffle files go when the table they were made for is written.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def write(self, label: str, *parts: DataFrame) -> DataFrame:
        """The rows of all parts, written one part after another, so that one part's shuffles exist at a time."""
        path = stage_path(self.spark, label)
        with swept(self.spark):
            for part in parts:
                part.write.mode("append").option("compression", "zstd").parquet(path)
        rows = self.spark.read.schema(parts[0].schema).parquet(path)
        self._paths[id(rows)] = rows, path
        return rows

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that ``write`` returned; others are left alone."""
        for table in tables:
            if id(table) in self._paths:
                delete_folder(self.spark, self._paths.pop(id(table))[1])


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that what is made of them stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    # A worker lives on after its task; what it holds for batches should not.
    pa.default_memory_pool().release_unused()
