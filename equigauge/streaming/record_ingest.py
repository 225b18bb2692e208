"""Record files to the cohort layer: rows, rejected files, counts and a ledger, batch by batch.

A batch of files, from a stream or from a listing, is processed the same way and under a number of
its own. All it writes goes to folders of that number, each replaced if the batch is done again,
and the ledger of its files comes last. Readers see the batches of the ledger only, so a batch that
was interrupted, wherever, is neither lost nor seen twice. Each file is read once: the counts are
observed on the rows as they are written.

Below ``root``: ``rows`` (kept records), ``rejects`` (file and category), ``counts`` (one row a
batch) and ``ledger`` (every file with its batch, status and number of records).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from equigauge.functions.text import file_name_parts
from equigauge.session import complete_folders, delete_folder, staged
from equigauge.sinks.cells import CellStore
from equigauge.sources.record_files import (
    FILE_SCHEMA, KEPT, RANGE_BYTES, list_record_files, listed, read_headers, read_ranges,
)

REJECT_LIMIT = 60
OTHER_NAME = "other name"
NAME_PARTS = ("state", "year", "month")


class TooManyRejects(ValueError):
    """The rejected files of all batches have reached the limit."""


@dataclass(frozen=True)
class RecordIngest:
    """Where an ingest writes, and what it makes of the records.

    ``transform`` gets the columns of the records with name, state, year and month of their file,
    and returns the rows to keep; a ``band`` among their columns is counted where it is null.
    """

    root: str
    columns: Mapping[str, str]
    transform: Callable[[DataFrame], DataFrame]
    years: tuple[int, int]
    partition_by: Sequence[str] = ("year",)
    reject_limit: int = REJECT_LIMIT
    range_bytes: int = RANGE_BYTES

    def folder(self, table: str, batch: int) -> str:
        return f"{self.root}/{table}/batch={batch}"

    def scratch(self, batch: int) -> Callable[[DataFrame, str], DataFrame]:
        """Writes a table that only this batch needs, and reads it back."""

        def write(df: DataFrame, label: str) -> DataFrame:
            path = f"{self.folder('scratch', batch)}/{label}"
            df.write.mode("overwrite").parquet(path)
            return df.sparkSession.read.schema(df.schema).parquet(path)

        return write

    def process(self, files: DataFrame, batch: int) -> None:
        """Write everything of a batch of files (path, length, name).

        A batch of the same files that is done already is left as it is. One of other files under a
        number that is taken is refused: its stream's checkpoint is not the one of this root.
        """
        spark = files.sparkSession
        if batch in batches(spark, self.root):
            known = spark.read.parquet(self.folder("ledger", batch)).select("path")
            if files.join(known, "path", "left_anti").isEmpty():
                return
            raise ValueError(f"batch {batch} of {self.root} is done with other files")
        headers = self.scratch(batch)(self._judged(files), "headers")
        bad = headers.filter("status <> 'ok'")
        bad.select("path", "name", F.col("status").alias("category")).write.mode("overwrite").parquet(
            self.folder("rejects", batch)
        )
        self._gate(headers.sparkSession, batch)
        read, kept, undefined = self._write_rows(headers, batch)
        totals = headers.agg(
            F.count("*").alias("files"),
            F.count_if(F.col("status") != "ok").alias("rejected"),
            F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
        ).withColumns(
            {"read": F.lit(read).cast("long"), "kept": F.lit(kept).cast("long"),
             "band_undefined": F.lit(undefined).cast("long")}
        )
        totals.write.mode("overwrite").parquet(self.folder("counts", batch))
        headers.select("path", "length", "name", "status", "records").write.mode("overwrite").parquet(
            self.folder("ledger", batch)
        )
        delete_folder(headers.sparkSession, self.folder("scratch", batch))

    def _judged(self, files: DataFrame) -> DataFrame:
        """Headers with the parts of the file's name; a name of another kind is a reject."""
        parts = file_name_parts(F.col("name"), self.years)
        return (
            read_headers(files)
            .drop("content")
            .withColumns(parts)
            .withColumn(
                "status",
                F.when((F.col("status") == "ok") & F.col("year").isNull(), F.lit(OTHER_NAME)).otherwise(
                    F.col("status")
                ),
            )
        )

    def _gate(self, spark: SparkSession, batch: int) -> None:
        """Rejects are kept even where they stop the ingest: the batch's own are written already."""
        done = batches(spark, self.root)
        rejects = spark.read.schema("path string, name string, category string, batch long").parquet(
            f"{self.root}/rejects"
        )
        counted = rejects.filter(F.col("batch").isin([*done, batch])).limit(self.reject_limit).count()
        if counted >= self.reject_limit:
            raise TooManyRejects(f"{self.reject_limit} or more files were rejected")

    def _write_rows(self, headers: DataFrame, batch: int) -> tuple[int, int, int]:
        # Parts of the name come with the headers, once a file, and go before columns of their names.
        own = {n: kind for n, kind in self.columns.items() if n.lower() not in NAME_PARTS}
        records = read_ranges(
            headers, own, self.range_bytes, self.scratch(batch), [*KEPT, *NAME_PARTS]
        )
        if records is None:
            # An attempt before, of other files, may have left some.
            delete_folder(headers.sparkSession, self.folder("rows", batch))
            return 0, 0, 0
        before, after = Observation(), Observation()
        named = records.select(*KEPT, *own, *NAME_PARTS)
        rows = self.transform(named.observe(before, F.count(F.lit(1)).alias("read")))
        undefined = F.count_if(F.col("band").isNull()) if "band" in rows.columns else F.lit(0)
        watched = rows.observe(
            after, F.count(F.lit(1)).alias("kept"), undefined.alias("band_undefined")
        )
        watched.write.mode("overwrite").partitionBy(*self.partition_by).parquet(self.folder("rows", batch))
        kept = after.get
        return before.get["read"], kept["kept"], kept["band_undefined"]


def batches(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the batches that are done."""
    return complete_folders(spark, f"{root}/ledger", "batch")


def ingested(spark: SparkSession, root: str, table: str = "rows") -> DataFrame:
    """A table of the batches that are done, with their number; the others' folders are not read."""
    done = set(batches(spark, root)).intersection(complete_folders(spark, f"{root}/{table}", "batch"))
    held = [f"{root}/{table}/batch={b}" for b in sorted(done)]
    if not held:
        raise FileNotFoundError(f"no batch of {root} has any {table}")
    return spark.read.option("basePath", f"{root}/{table}").parquet(*held)


def refresh_cells(spark: SparkSession, root: str, cells: CellStore) -> list[int]:
    """Roll up the batches of an ingest that the cells do not have yet; their numbers.

    Only the rows of those batches are read.
    """
    have = cells.batches()
    kept = set(complete_folders(spark, f"{root}/rows", "batch"))
    new = [b for b in batches(spark, root) if b in kept and b not in have]
    for batch in new:
        cells.add(spark.read.parquet(f"{root}/rows/batch={batch}"), batch)
    return new


def ingest_stream(
    spark: SparkSession,
    source: str,
    ingest: RecordIngest,
    checkpoint: str,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """All files that are new since the checkpoint, a batch at a time; then it stops."""
    files = listed(
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(source)
    )
    query = (
        files.writeStream.foreachBatch(ingest.process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def ingest_new(
    spark: SparkSession, source: str, ingest: RecordIngest, files_per_batch: int = 1000
) -> list[int]:
    """The same without a stream: files that no batch of the ledger has; the batches it made."""
    made: list[int] = []
    while True:
        done = batches(spark, ingest.root)
        files = list_record_files(spark, source)
        if done:
            known = ingested(spark, ingest.root, "ledger").select("path")
            files = files.join(known, "path", "left_anti")
        batch = staged(files.orderBy("path").limit(files_per_batch), "ingest-batch")
        if batch.isEmpty():
            return made
        made.append(max(done, default=-1) + 1)
        ingest.process(batch, made[-1])
