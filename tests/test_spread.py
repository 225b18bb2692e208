"""Steps that make many rows out of one, and files of many small ranges, are dealt over tasks and batches."""

import gzip
import pathlib
from datetime import date
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from equigauge import session
from equigauge.functions.numeric import whole
from equigauge.functions.text import file_name_parts
from equigauge.operators.rollup import first_attributes
from equigauge.plans import workload
from equigauge.plans.catalogue import record_files as catalogue
from equigauge.plans.catalogue.sources import census_bands, census_files
from equigauge.plans.catalogue.tables import export_round_trip
from equigauge.plans.workload import TABLES_STUDY, Layers
from equigauge.session import spread, stage_root, tune
from equigauge.sinks import record_files as sink
from equigauge.sinks.record_files import Field, write_named, write_record_files
from equigauge.sources import record_files
from equigauge.sources.record_files import read_record_files

FIELDS = [Field("CODE", "C", 6), Field("AGE", "N", 3)]
COLUMNS = {"CODE": "text", "AGE": "number"}
YEARS = (2000, 2030)


@pytest.fixture
def layers(spark, tmp_path):
    customers = [(i, f"c{i}", i % 2, float(i)) for i in range(50)]
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_nationkey int, c_acctbal double").coalesce(
        1).write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(0, "A", 0), (1, "B", 1)], "n_nationkey int, n_name string, n_regionkey int").coalesce(
        1).write.parquet(str(tmp_path / "nation.parquet"))
    spark.createDataFrame([(0, "X"), (1, "Y")], "r_regionkey int, r_name string").coalesce(
        1).write.parquet(str(tmp_path / "region.parquet"))
    return Layers(tune(spark), str(tmp_path))


def tasks_of(df):
    return df.select(F.spark_partition_id().alias("t")).distinct().count()


def test_spread_deals_rows_over_tasks(spark, monkeypatch):
    df = spark.range(100).coalesce(1)
    assert spread(df) is df
    monkeypatch.setattr(session, "SPREAD_ROWS", 10)
    assert spread(df).rdd.getNumPartitions() == 10 and spread(df, 35).rdd.getNumPartitions() == 4
    assert sorted(r["id"] for r in spread(df).collect()) == list(range(100))


def test_census_is_made_by_many_tasks(layers, monkeypatch):
    expected = sorted(tuple(r) for r in layers.census.collect())
    bands = sorted(tuple(r) for r in census_bands(layers).collect())
    monkeypatch.setattr(session, "SPREAD_ROWS", 10)
    many = Layers(layers.spark, layers.sf_dir)
    assert tasks_of(layers.census) == 1 and tasks_of(many.census) == 5
    assert sorted(tuple(r) for r in many.census.collect()) == expected
    for query in (census_bands, census_files):
        assert sorted(tuple(r) for r in query(many).collect()) == bands
    plan = census_bands(many)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition 5" in plan


def test_buckets_are_reckoned_by_the_joined_rows(layers, monkeypatch):
    seen = []
    monkeypatch.setattr(workload, "colocate", lambda spark, tables, key, rows: seen.append(rows) or tables)
    layers.__dict__.update(events=None, coverage=None)
    layers.colocated
    assert seen == [50 * 14 * 7]


@pytest.fixture
def records(layers, spark):
    """Lines of orders of the customers, one of an order that no customer has."""
    top, day = layers.sf_dir, date(1998, 3, 1)
    orders = [(i, 777 if i == 90 else i % 50, "F", 100.0 * i, day) for i in range(100)]
    lines = [(i % 100, i % 5, 3, i % 6 + 1, float(i % 50 + 1), 10.5 * i, 0.01 * (i % 8), "RAN"[i % 3], "FO"[i % 2], date(1998, 3, 9))
             for i in range(600)]
    parts = [(i, f"{t} X", 4 + i) for i, t in enumerate(["ECONOMY", "STANDARD", "MEDIUM", "PROMO", "LARGE"])]
    for name, rows, schema in (
        ("orders", orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date"),
        ("lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double,"
         " l_extendedprice double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date"),
        ("part", parts, "p_partkey long, p_type string, p_size int"),
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{top}/{name}.parquet")
    return layers


def test_grid_by_entity_is_the_grid_without_its_shuffle(records, spark, monkeypatch):
    monkeypatch.setattr(workload, "bucket_count", lambda rows: 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        grid = records.gold_by_entity
        assert "Exchange" not in grid._jdf.queryExecution().executedPlan().toString()
        rows = sorted(map(str, grid.collect()))
        assert rows == sorted(map(str, records.gold.collect())) and len(rows) == 50 * records.cells_per_entity
        assert grid.agg(F.sum("cases")).first()[0] > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_exported_facts_are_compressed_and_records_read_once(records, spark):
    top = pathlib.Path(stage_root(spark), "equigauge", spark.sparkContext.applicationId)
    before = set(top.glob("facts-*"))
    checks = export_round_trip(records)
    assert "lineitem.parquet" not in checks._jdf.queryExecution().optimizedPlan().toString()
    assert not any("lineitem.parquet" in f for f in checks.inputFiles())
    row = checks.first()
    assert row["source_total"] == row["exported_total"] == records.cells().agg(F.sum("cases")).first()[0] > 0
    (facts,) = set(top.glob("facts-*")) - before
    files = [f for f in facts.iterdir() if f.name.startswith("part-")]
    assert files and all(f.name.endswith(".csv.gz") for f in files)
    texts = [gzip.decompress(f.read_bytes()).decode("utf-8-sig") for f in files]
    assert sum(len(t.splitlines()) - 1 for t in texts if t) == 50 * records.cells_per_entity


def test_attributes_are_distinct_before_they_are_sorted(spark):
    df = spark.createDataFrame([("a", None), ("a", "SP"), ("a", "SP"), ("b", None)], "entity string, state string")
    got = first_attributes(df, "entity", ["state"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate(keys=[entity") == 2
    assert {tuple(r) for r in got.collect()} == {("a", "SP"), ("b", None)}


def test_small_ranges_share_a_batch(tmp_path):
    path = tmp_path / "f"
    path.write_bytes(bytes(range(60)))
    rows = [(str(path), i * 20, 20, 10) for i in range(3)]
    names = ["path", "at", "size", "record_length"]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
    out = list(record_files._pieces(iter([batch])))
    assert len(out) == 1 and out[0].schema.names == [*names, "_chunk"]
    assert out[0].column("at").to_pylist() == [0, 20, 40]
    assert b"".join(out[0].column("_chunk").to_pylist()) == bytes(range(60))


def test_batches_of_pieces_are_bounded(tmp_path, monkeypatch):
    monkeypatch.setattr(record_files, "PIECE_BYTES", 25)
    path = tmp_path / "f"
    path.write_bytes(bytes(range(60)))
    batch = pa.RecordBatch.from_pydict({"path": [str(path)] * 2, "at": [0, 50], "size": [50, 10], "record_length": [10, 10]})
    out = list(record_files._pieces(iter([batch])))
    assert [[len(c) for c in b.column("_chunk").to_pylist()] for b in out] == [[20, 20], [10, 10]]
    with pytest.raises(OSError):
        list(record_files._pieces(iter([batch.set_column(2, "size", pa.array([50, 20]))])))


def test_name_parts_come_once_a_file(spark, tmp_path):
    path, empty = str(tmp_path / "in"), str(tmp_path / "none")
    df = spark.createDataFrame([("RDSP1902", f"{i:06d}", i) for i in range(30)], "file string, CODE string, AGE int")
    write_record_files(df, path, "file", FIELDS)
    parts = file_name_parts(F.col("name"), YEARS)
    got = read_record_files(spark, path, COLUMNS, 100, parts)
    assert {tuple(r) for r in got.select(*parts).distinct().collect()} == {("SP", 2019, 2)} and got.count() == 30
    records = got._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in records
    write_named(spark.createDataFrame([("RDSP1902", "cut")], "file string, bytes string"), empty, "file", "bytes")
    none = read_record_files(spark, empty, COLUMNS, 100, parts)
    assert none.count() == 0 and none.select(*got.columns).dtypes == got.dtypes


def test_records_are_made_once(spark, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(sink, "staged", lambda df, label: made.append(label) or session.staged(df, label))
    df = spark.createDataFrame([("a", "x", 1), ("b", "y", None)], "file string, CODE string, AGE int")
    assert write_record_files(df, str(tmp_path / "in"), "file", FIELDS) == 2 and made == ["records"]


def test_drifting_tree_makes_the_records_once(spark, monkeypatch):
    row = ("1", "1", 30, "4", " eco0 ", "0408050000", "1", 0, 1.5, 2)
    raw = spark.createDataFrame(
        [(*row, 1996, 3), (*row, 1996, 9)],
        "MUNIC_RES string, SEXO string, IDADE int, COD_IDADE string, DIAG_PRINC string, PROC_REA string, "
        "IDENT string, MORTE int, VAL_TOT double, DIAS_PERM int, year int, month int")
    made = []
    monkeypatch.setattr(catalogue, "staged", lambda df, label: made.append(label) or session.staged(df, label))
    got = catalogue.drifting_tree(SimpleNamespace(spark=tune(spark), raw=raw, study=TABLES_STUDY)).collect()
    assert [tuple(r) for r in got] == [(1996, 2, 1, 4, 30.0, 3.0)] and made == ["raw"]
    assert stage_root(spark)


def test_whole_counts(column_of):
    values = [0.5, 1.5, -0.5, 2.4999999999, 1e15, None]
    assert column_of(values, "double", lambda x: whole(F.col(x))) == [0, 2, 0, 2, 10**15, None]


def test_long_methods_are_cut(spark):
    assert tune(spark).conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
