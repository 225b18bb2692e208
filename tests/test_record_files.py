import re

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from equigauge.functions.text import file_name_parts
from equigauge.operators.validate import completeness_of, expected_files, missing_inputs
from equigauge.sinks.record_files import Field, write_named, write_record_files
from equigauge.sources import record_files
from equigauge.sources.record_files import list_record_files, read_record_files
from equigauge.streaming.record_ingest import (
    OTHER_NAME, RecordIngest, TooManyRejects, ingest_new, ingest_stream, ingested,
)
from tests.test_sources import RECORDS, WANTED, table_bytes

FIELDS = [Field("CODE", "C", 6), Field("AGE", "N", 3), Field("PAID", "N", 9)]
COLUMNS = {"CODE": "text", "AGE": "number", "PAID": "number"}
YEARS = (2000, 2030)


def people(spark, names, n=40):
    rows = [(name, f"{i:06d}", None if i % 5 == 0 else i, f"{i / 4:.2f}") for name in names for i in range(n)]
    return spark.createDataFrame(rows, "file string, CODE string, AGE int, PAID string")


def test_files_are_read_by_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(record_files, "PIECE_BYTES", 64)
    path = str(tmp_path / "in")
    df = people(spark, ["RDSP1901", "RDRJ1902"])
    assert write_record_files(df, path, "file", FIELDS) == 2
    # A record is 20 bytes: 6 ranges a file, each of several pieces.
    got = read_record_files(spark, path, COLUMNS, range_bytes=150)
    tasks = got.select("name", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(tasks) > 2 == len({r["name"] for r in tasks})
    rows = sorted((r["name"][:8], r["CODE"], r["AGE"], r["PAID"]) for r in got.collect())
    assert rows == sorted((r["file"], r["CODE"], r["AGE"], float(r["PAID"])) for r in df.collect())
    whole = read_record_files(spark, path)
    assert whole.columns == ["path", "name", "CODE", "AGE", "PAID", "EOL"]
    assert whole.drop("EOL").exceptAll(got).count() == 0


def test_large_names_are_split(spark, tmp_path):
    path = str(tmp_path / "in")
    n = write_record_files(people(spark, ["RDSP1901"], 400), path, "file", FIELDS, file_records=50)
    names = {r["name"] for r in list_record_files(spark, path).collect()}
    assert n == len(names) > 4 and all(x.startswith("RDSP1901.p") for x in names)
    assert read_record_files(spark, path, COLUMNS).agg(F.countDistinct("CODE"), F.count("*")).first()[:] == (400, 400)


def test_only_selected_columns_are_decoded(spark, tmp_path):
    path = str(tmp_path / "in")
    write_record_files(people(spark, ["RDSP1901"]), path, "file", FIELDS)
    got = read_record_files(spark, path, COLUMNS)
    decoded = lambda df: set(
        re.findall(r"substring\(_record#\d+, _(\w+)#", df._jdf.queryExecution().optimizedPlan().toString())
    )
    assert decoded(got) == set(COLUMNS) and decoded(got.select("AGE")) == {"AGE"}
    listing = list_record_files(spark, path)
    assert "content" not in listing._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_odd_files(spark, tmp_path):
    (tmp_path / "a.dbf").write_bytes(table_bytes(RECORDS))
    (tmp_path / "more than there are.dbf").write_bytes(table_bytes(RECORDS[:1], declared=7))
    (tmp_path / "none.dbf").write_bytes(table_bytes([]))
    (tmp_path / "short.dbf").write_bytes(b"x" * 31)
    (tmp_path / "empty.dbf").write_bytes(b"")
    got = read_record_files(spark, str(tmp_path), WANTED | {"ABSENT": "text"}, range_bytes=1)
    assert sorted(r["MUNIC_RES"] for r in got.collect()) == ["120001", "230440", "355030", "355030"]
    assert {r["ABSENT"] for r in got.collect()} == {None}
    only = tmp_path / "only"
    only.mkdir()
    (only / "none.dbf").write_bytes(table_bytes([]))
    empty = read_record_files(spark, str(only), WANTED)
    assert empty.count() == 0 and empty.columns == ["path", "name", *WANTED]


def kept(df):
    return df.filter(F.col("AGE").isNotNull()).select(
        "CODE", "AGE", "state", "year", "month", F.when(F.col("AGE") > 10, "old").alias("band")
    )


def folders(tmp_path):
    return (str(tmp_path / n) for n in ("in", "out", "log"))


def account(spark, root):
    rows = ingested(spark, root).groupBy("state", "year", "month").count().collect()
    totals = ingested(spark, root, "counts").agg(
        *[F.sum(c) for c in ("files", "rejected", "read", "kept", "band_undefined")]
    ).first()
    rejects = ingested(spark, root, "rejects").groupBy("category").count().collect()
    return sorted(map(tuple, rows)), tuple(totals), sorted(map(tuple, rejects))


def write_broken(spark, path, names):
    rows = [(n, "cut" if n.startswith("RD") else "x" * 64) for n in names]
    df = spark.createDataFrame(rows, "file string, bytes string")
    write_named(df.select(F.coalesce("file", F.lit("")).alias("file"), "bytes"), path, "file", "bytes")


@pytest.mark.parametrize("streamed", [True, False])
def test_ingest_of_files(spark, tmp_path, streamed):
    source, root, log = folders(tmp_path)
    job = RecordIngest(root, COLUMNS, kept, YEARS, range_bytes=200)
    run = lambda: (
        ingest_stream(spark, source, job, log, files_per_batch=2)
        if streamed
        else ingest_new(spark, source, job, files_per_batch=2)
    )
    names = [f"RDSP19{m:02d}" for m in range(1, 6)]
    write_record_files(people(spark, names), source, "file", FIELDS)
    write_record_files(people(spark, ["readme"], 3), source, "file", FIELDS)
    write_broken(spark, source, ["RDSP1909", "RDSP1910"])
    run()
    per_file, undefined = 32, 8
    want = (
        [("SP", 2019, m, per_file) for m in range(1, 6)],
        (8, 3, 200, 5 * per_file, 5 * undefined),
        sorted([("truncated header", 2), (OTHER_NAME, 1)]),
    )
    assert account(spark, root) == want
    run()
    assert account(spark, root) == want
    write_record_files(people(spark, ["RDAC2001"]), source, "file", FIELDS)
    run()
    rows, totals, _ = account(spark, root)
    assert rows[0] == ("AC", 2020, 1, per_file) and totals == (9, 3, 240, 6 * per_file, 6 * undefined)
    ledger = ingested(spark, root, "ledger")
    assert ledger.count() == ledger.select("path").distinct().count() == 9
    assert not (tmp_path / "out" / "scratch" / "batch=0").exists()


@pytest.mark.parametrize("streamed", [True, False])
def test_a_crash_between_and_within_batches(spark, tmp_path, streamed):
    """More batches than the progress keeps, one stopped in the middle of its writes."""
    source, root, log = folders(tmp_path)
    write_record_files(people(spark, [f"RDSP19{m:02d}" for m in range(1, 6)]), source, "file", FIELDS)
    calls = []

    def stops(df):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return kept(df)

    run = lambda transform: (
        ingest_stream(spark, source, RecordIngest(root, COLUMNS, transform, YEARS), log, 1)
        if streamed
        else ingest_new(spark, source, RecordIngest(root, COLUMNS, transform, YEARS), 1)
    )
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        with pytest.raises((RuntimeError, StreamingQueryException)):
            run(stops)
        assert ingested(spark, root).count() == 64
        # Rows of a batch that did not come to its end are there, but nobody sees them.
        people(spark, ["x"]).withColumn("year", F.lit(2019)).write.partitionBy("year").parquet(f"{root}/rows/batch=2")
        assert ingested(spark, root).count() == 64
        run(kept)
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    rows, totals, rejects = account(spark, root)
    assert rows == [("SP", 2019, m, 32) for m in range(1, 6)]
    assert totals == (5, 0, 200, 160, 40) and rejects == []


@pytest.mark.parametrize("streamed", [True, False])
def test_too_many_rejects_stop_the_ingest(spark, tmp_path, streamed):
    source, root, log = folders(tmp_path)
    write_broken(spark, source, [f"RDSP19{m:02d}" for m in range(1, 8)])
    job = RecordIngest(root, COLUMNS, kept, YEARS, reject_limit=5)
    if streamed:
        with pytest.raises(StreamingQueryException, match="5 or more files"):
            ingest_stream(spark, source, job, log, 2)
    else:
        with pytest.raises(TooManyRejects):
            ingest_new(spark, source, job, 2)
    # Two batches are done; the third's rejects are kept, too, beside them.
    assert ingested(spark, root, "rejects").count() == 4
    assert spark.read.parquet(f"{root}/rejects").count() == 6


def test_a_checkpoint_of_another_root(spark, tmp_path):
    source, root, log = folders(tmp_path)
    job = RecordIngest(root, COLUMNS, kept, YEARS)
    write_record_files(people(spark, ["RDSP1901"]), source, "file", FIELDS)
    ingest_stream(spark, source, job, log)
    # The same files under the same number: nothing is done twice.
    ingest_stream(spark, source, job, log + "-lost")
    assert account(spark, root)[1] == (1, 0, 40, 32, 8)
    write_record_files(people(spark, ["RDSP1902"]), source, "file", FIELDS)
    with pytest.raises(StreamingQueryException, match="done with other files"):
        ingest_stream(spark, source, job, log + "-lost-again")
    assert account(spark, root)[1] == (1, 0, 40, 32, 8)
    ingest_stream(spark, source, job, log)
    assert account(spark, root)[1] == (2, 0, 80, 64, 16)


def test_expected_files(spark, tmp_path):
    source = str(tmp_path / "in")
    write_record_files(people(spark, ["RDSP1901", "RDSP1903", "RDRJ1902", "RDXX1901", "other"], 2), source, "file", FIELDS)
    parts = file_name_parts(F.col("name"), YEARS)
    held = list_record_files(spark, source).select(*[c.alias(n) for n, c in parts.items()])
    expected = expected_files(spark, ["SP", "RJ"], [2019], [1, 2, 3])
    assert expected.count() == 6 and expected.dtypes == [("state", "string"), ("year", "int"), ("month", "int")]
    keys = ["state", "year", "month"]
    gone = missing_inputs(expected, held, keys)
    assert sorted(map(tuple, gone.collect())) == [("RJ", 2019, 1), ("RJ", 2019, 3), ("SP", 2019, 2)]
    row = completeness_of(expected, held.join(expected, keys, "left_semi"), keys).first()
    assert (row["expected"], row["processed"], row["missing"], row["passed"]) == (6, 3, 3, False)
