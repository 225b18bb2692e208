from equigauge import health_study
from equigauge.operators.cohort import to_bronze
from equigauge.streaming.ingest import METRICS, ingest, progress_counts, stream_files, watched
from tests.test_layers import RAW
from pyspark.sql import functions as F

STUDY = health_study()


def rows(n, start=0):
    return [("355030", "1", 45 if i % 4 else None, "4", "E119" if i % 3 else "I10", "0408050020",
             "1", 0, 1.0, 1, 2019, 1) for i in range(start, start + n)]


def test_each_file_is_ingested_once(spark, tmp_path):
    source, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    run = lambda: ingest(stream_files(spark, source, RAW), lambda df: to_bronze(df, STUDY), out, log,
                         partition_by=["year"])
    spark.createDataFrame(rows(12), RAW).coalesce(1).write.parquet(source)
    run()
    assert spark.read.parquet(out).count() == 8
    run()
    assert spark.read.parquet(out).count() == 8
    spark.createDataFrame(rows(6), RAW).coalesce(1).write.mode("append").parquet(source)
    run()
    assert spark.read.parquet(out).count() == 12


def test_progress_counts(spark, tmp_path):
    source, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    spark.createDataFrame(rows(12), RAW).repartition(3).write.parquet(source)

    def transform(df):
        marked = df.withColumn("kept", F.col("DIAG_PRINC") == "E119").withColumn(
            "band", F.when(F.col("IDADE").isNotNull(), "known"))
        return watched(marked).filter("kept").drop("kept")

    query = ingest(stream_files(spark, source, RAW, files_per_batch=1), transform, out, log)
    assert progress_counts(query) == {"read": 12, "kept": 8, "band_undefined": 2}
    assert METRICS in query.lastProgress.observedMetrics
