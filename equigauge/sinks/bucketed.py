"""Tables that are laid out by a key, so that joins and sums by it need no shuffle.

All tables of one layout have the same number of buckets. A join by the key and more columns is
satisfied by the key alone where ``spark.sql.requireAllClusterKeysForCoPartition`` is off, which
`colocate` sees to.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from equigauge.session import stage_path

#: Rows of the largest table in one bucket, about, counted as often as a join repeats them.
BUCKET_ROWS = 4_000_000
LEAST_BUCKETS = 8


def bucket_count(rows: int) -> int:
    return max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))


def write_bucketed(df: DataFrame, label: str, key: str, buckets: int) -> DataFrame:
    """The same rows from a table of ``buckets`` buckets by the key, sorted by it in each.

    Every bucket is one file, written by one task. The table is the session's; its files are
    staged like others and go with them.
    """
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    (
        df.repartition(buckets, key)
        .write.bucketBy(buckets, key)
        .sortBy(key)
        .option("path", stage_path(spark, label))
        .saveAsTable(name)
    )
    return spark.table(name)


def colocate(spark: SparkSession, tables: dict[str, DataFrame], key: str, rows: int) -> dict[str, DataFrame]:
    """All tables in one layout by the key. ``rows`` is the size of the largest, as it is joined."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    buckets = bucket_count(rows)
    return {name: write_bucketed(df, name, key, buckets) for name, df in tables.items()}
