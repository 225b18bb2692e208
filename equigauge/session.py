"""Session settings and staged tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings that make the plans hold at scale; all may be overridden per session.
ADAPTIVE_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join side even where that costs one more shuffle downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Where every partition of one side is small, join by hash instead of sorting both sides.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "32m",
    # The JVM leaves longer methods uncompiled; wide projections of parsing are cut into short ones.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
}

#: Rows of one task where each of them becomes many.
SPREAD_ROWS = 20_000

_staged: dict[str, list[str]] = {}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in ADAPTIVE_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def stage_root(spark: SparkSession) -> str:
    """Shared folder for staged tables: the one the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a folder below the warehouse, which every executor can reach too.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"


def stage_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    app = spark.sparkContext.applicationId
    path = f"{stage_root(spark)}/equigauge/{app}/{label}-{uuid.uuid4().hex}"
    _staged.setdefault(app, []).append(path)
    return path


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The same rows dealt over tasks of about `SPREAD_ROWS`, for a step that makes many out of one.

    A table is read by as many tasks as its bytes ask for, so one of few and short columns may be
    a single task however many rows come out of it. Rows are counted where the caller does not know
    about how many there are; a table that fits into one task is left as it is.
    """
    tasks = -(-(df.count() if rows is None else rows) // SPREAD_ROWS)
    return df.repartition(tasks) if tasks > 1 else df


def staged(df: DataFrame, label: str) -> DataFrame:
    """The same rows, read back from a table written once to the shared folder.

    Cuts lineage where several later steps need one result. The files outlive any executor,
    and unlike an in-memory copy they do not have to be recomputed when one is lost.
    """
    spark = df.sparkSession
    path = stage_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Spark's setting by which an execution takes its shuffle files with it.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is executed herein go when it ends.

    Else they lie on the disks until the driver happens to collect its garbage.
    """
    before = spark.conf.get(SWEEP, None)
    spark.conf.set(SWEEP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SWEEP)
        else:
            spark.conf.set(SWEEP, before)


def delete_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def complete_folders(spark: SparkSession, root: str, key: str) -> list[int]:
    """Numbers n of the folders ``key=n`` below a root whose write has come to its end."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    below = hadoop.Path(root)
    system = below.getFileSystem(spark._jsc.hadoopConfiguration())
    marks = system.globStatus(hadoop.Path(below, f"{key}=*/_SUCCESS")) or []
    return sorted(int(m.getPath().getParent().getName().removeprefix(f"{key}=")) for m in marks)


def release_stages(spark: SparkSession) -> int:
    """Delete the staged tables of this application; call when their readers are done."""
    paths = _staged.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        delete_folder(spark, path)
    return len(paths)
