"""Files to the cohort layer, each file once.

The file source records which files it has taken and the sink commits per batch, so a second run
skips what is done and an interrupted run goes on where it stopped. All steps are stateless.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

METRICS = "ingest"


def stream_files(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    name_filter: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def watched(df: DataFrame, kept: str = "kept") -> DataFrame:
    """Count rows on their way through: read, kept, and kept without a band."""
    keep = F.coalesce(F.col(kept), F.lit(False))
    return df.observe(
        METRICS,
        F.count(F.lit(1)).alias("read"),
        F.count_if(keep).alias("kept"),
        F.count_if(keep & F.col("band").isNull()).alias("band_undefined"),
    )


def ingest(
    source: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    partition_by: Sequence[str] = (),
) -> StreamingQuery:
    """Process everything that is new, then stop."""
    writer = (
        transform(source)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = writer.start()
    query.awaitTermination()
    return query


def ingest_counted(
    source: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    path: str,
    marks: str,
    checkpoint: str,
    keys: Sequence[str],
    files_apart: Sequence[str] = (),
) -> None:
    """`ingest`, and beside it a table of narrow marks, the keys of every row that was read.

    Both sinks take the same files once, so `ingest_counts` is right for any number of batches
    and runs, which the progress that Spark keeps is not.
    """
    ingest(source, transform, path, f"{checkpoint}/rows", files_apart)
    ingest(source, lambda df: df.select(*keys), marks, f"{checkpoint}/marks")


def ingest_counts(marks: DataFrame, kept: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows read, rows kept, and rows kept without a band, by keys."""
    read = marks.groupBy(*keys).agg(F.count("*").alias("read"))
    out = kept.groupBy(*keys).agg(
        F.count("*").alias("kept"), F.count_if(F.col("band").isNull()).alias("band_undefined")
    )
    return read.join(out, list(keys), "left").fillna(0, subset=["kept", "band_undefined"])


def progress_counts(query: StreamingQuery) -> dict[str, int]:
    """Observed counts added up over the batches of a run.

    Spark keeps the progress of the last hundred batches or so; of a longer run the counts would
    be too small, so they are refused; count the written table then.
    """
    totals: dict[str, int] = {}
    held = query.recentProgress
    conf = SparkSession.active().conf
    kept = int(conf.get("spark.sql.streaming.numRecentProgressUpdates"))
    if len(held) >= kept:
        raise ValueError("the run has more batches than progress is kept for")
    for progress in held:
        row = progress.observedMetrics.get(METRICS)
        if row is not None:
            for name, value in row.asDict().items():
                totals[name] = totals.get(name, 0) + value
    return totals
