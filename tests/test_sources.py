import json
import struct

import pytest
from pyspark.sql import functions as F

from equigauge.sinks.files import (
    decimal_comma, write_csv, write_locale_csv, write_parquet, write_partitioned,
)
from equigauge.sources import fixed_width
from equigauge.sources.fixed_width import decode_files, file_headers, read_fixed_width
from equigauge.sources.nested import (
    add_areas,
    COVERAGE_SCHEMA, COVERAGE_SERIES, annual_coverage, coverage_rows, crosstab_to_long,
    flatten_census, regroup_bands, union_coverage,
)
from equigauge.sources.tables import read_csv, read_locale_csv, read_tree, sql_statements

FIELDS = ((b"MUNIC_RES", b"C", 6), (b"DIAG_PRINC", b"C", 4), (b"IDADE", b"N", 3),
          (b"VAL_TOT", b"N", 10))


def table_bytes(records, declared=None):
    head = 32 + 32 * len(FIELDS) + 1
    size = 1 + sum(f[2] for f in FIELDS)
    out = struct.pack("<B3BIHH20x", 3, 24, 1, 1, len(records) if declared is None else declared,
                      head, size)
    for name, kind, width in FIELDS:
        out += name.ljust(11, b"\0") + kind + b"\0" * 4 + bytes([width]) + b"\0" * 15
    return out + b"\r" + b"".join(records) + b"\x1a"


RECORDS = [b" 355030E119 45    321.68", b" 230440E14  70    360.80",
           b"*999999E149 70    360.80", b" 120001E10 bad      0.00"]
WANTED = {"MUNIC_RES": "text", "DIAG_PRINC": "text", "IDADE": "number", "VAL_TOT": "number"}


def test_fixed_width_files(spark, tmp_path):
    (tmp_path / "a.dbf").write_bytes(table_bytes(RECORDS))
    (tmp_path / "b.dbf").write_bytes(table_bytes(RECORDS[:1], declared=7))
    (tmp_path / "c.dbf").write_bytes(table_bytes([]))
    got = read_fixed_width(spark, str(tmp_path), WANTED)
    rows = {tuple(r)[1:] for r in got.filter(F.endswith("path", F.lit("a.dbf"))).collect()}
    assert rows == {("355030", "E119", 45.0, 321.68), ("230440", "E14", 70.0, 360.8),
                    ("120001", "E10", None, 0.0)}
    assert got.count() == 4
    few = read_fixed_width(spark, str(tmp_path), {"VAL_TOT": "number", "ABSENT": "text"})
    assert few.columns == ["path", "VAL_TOT", "ABSENT"]
    assert {r["ABSENT"] for r in few.collect()} == {None}


def test_fixed_width_all_columns_in_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fixed_width, "CHUNK", 2)
    (tmp_path / "a.dbf").write_bytes(table_bytes(RECORDS * 3))
    got = read_fixed_width(spark, str(tmp_path))
    assert got.columns == ["path", *[f[0].decode() for f in FIELDS]]
    assert {f.name for f in got.schema if f.dataType.typeName() == "double"} == {
        f[0].decode() for f in FIELDS if f[1] == b"N"}
    assert got.count() == 9
    assert got.select(*WANTED).exceptAll(read_fixed_width(spark, str(tmp_path), WANTED).select(*WANTED)).count() == 0


def test_broken_files_are_marked(spark):
    files = spark.createDataFrame(
        [("short", b"abc"), ("null", None), ("ok", table_bytes(RECORDS)), ("zero", b"\0" * 40)],
        "path string, content binary")
    got = {r["path"]: r["status"] for r in file_headers(files).collect()}
    assert got == {"short": "truncated header", "null": "truncated header", "ok": "ok",
                   "zero": "bad record length"}
    assert decode_files(files, WANTED).count() == 3


def test_empty_table_keeps_its_columns(spark):
    files = spark.createDataFrame([("a", table_bytes([]))], "path string, content binary")
    got = decode_files(files, WANTED)
    assert got.count() == 0 and got.schema["VAL_TOT"].dataType.simpleString() == "double"


def test_census_response(spark):
    def result(sex, group, values):
        return {"classificacoes": [{"categoria": {sex: "s"}}, {"categoria": {group: "g"}}],
                "series": [{"localidade": {"id": e}, "serie": {"2022": v}}
                           for e, v in values.items()]}
    doc = [{"resultados": [result("4", "93070", {"3550308": "10", "2304400": "..."}),
                           result("4", "93084", {"3550308": "5"}),
                           result("5", "6653", {"3550308": "7"}),
                           result("9", "1", {"3550308": "1"})]}]
    docs = spark.createDataFrame([(json.dumps(doc),)], "json string")
    got = {tuple(r) for r in regroup_bands(flatten_census(docs)).collect()}
    assert got == {("3550308", "M", "<30", 15), ("2304400", "M", "<30", 0),
                   ("3550308", "F", "80+", 7), ("3550308", None, None, 1)}


def test_coverage_series(spark):
    rows = [("355030", "201901", "85,30", None), ("355030", "201902", "86,30", None),
            ("355030", "01/2021", None, "120.5"), ("355030", "02/2021", None, None),
            ("230440", "201901", "1.000,00", None)]
    records = spark.createDataFrame(rows, COVERAGE_SCHEMA)
    both = union_coverage([coverage_rows(records, s) for s in COVERAGE_SERIES])
    got = {tuple(r) for r in annual_coverage(both).collect()}
    assert got == {("355030", 2019, "cobertura_ab", 85.8), ("230440", 2019, "cobertura_ab", 1000.0),
                   ("355030", 2021, "cobertura_aps", 120.5)}


def test_crosstab(spark):
    text = ('Header\n"Area";"2019";"2020";"Total"\r\n"11 Rondonia";"1.234";"-";"1.234"\n'
            '"35 Sao Paulo";"";"7";"7"\n"99 Nowhere";"1";"1";"2"\n"Total";"1";"2";"3"\nfoot')
    got = crosstab_to_long(spark.createDataFrame([(text,), ("no table",)], "value string"))
    assert {tuple(r) for r in got.collect()} == {
        ("RO", 2019, 1234), ("RO", 2020, 0), ("SP", 2019, 0), ("SP", 2020, 7)}


def test_locale_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [("01", 1.5, 12345678.9, True), ("02", None, -3.0, False), ("çã", 0.0001, 96.0, None)],
        "code string, x double, big double, flag boolean")
    path = str(tmp_path / "out")
    write_locale_csv(df.coalesce(1), path)
    raw = next((tmp_path / "out").glob("*.csv")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfcode;x;big;flag")
    lines = raw.decode("utf-8-sig").splitlines()
    assert lines[1:3] == ["01;1,5;12345678,9;True", "02;;-3,0;False"]
    back = read_locale_csv(spark, path, df.columns, {"x": "double", "big": "double"})
    assert [tuple(r)[:3] for r in back.orderBy("code").collect()] == [
        ("01", 1.5, 12345678.9), ("02", None, -3.0), ("çã", 0.0001, 96.0)]


def test_locale_csv_with_other_columns_is_refused(spark, tmp_path):
    path = str(tmp_path / "csv")
    write_locale_csv(spark.createDataFrame([("a", 1.5)], "code string, x double"), path)
    assert read_locale_csv(spark, path, ["code", "x"], {"x": "double"}).first()["x"] == 1.5
    with pytest.raises(ValueError, match="are wanted"):
        read_locale_csv(spark, path, ["x", "code"], {"x": "double"})


def test_decimal_comma_never_uses_exponents(column_of):
    got = column_of([1e7, 1.25e9, 0.0005, -2e8, None], "double", lambda c: decimal_comma(F.col(c)))
    assert got == ["10000000,0", "1250000000,0", "0,0005", "-200000000,0", None]
    got = column_of([1e-13, 1e30, -1.25e-9, 1.2345678901234567e8, float("nan")], "double",
                    lambda c: decimal_comma(F.col(c)))
    assert got == ["0,0000000000001", "1" + "0" * 30 + ",0", "-0,00000000125", "123456789,01234567",
                   "NaN"]


def test_partitioned_write_can_be_repeated(spark, tmp_path):
    path = str(tmp_path / "tree")
    first = spark.createDataFrame([(1, "a"), (2, "b")], "x int, k string")
    for _ in range(2):
        write_partitioned(first, path, ["k"])
    write_partitioned(first.filter("k = 'b'").withColumn("x", F.lit(5)), path, ["k"])
    assert sorted((r["x"], r["k"]) for r in read_tree(spark, path).collect()) == [(1, "a"), (5, "b")]


def test_areas_of_a_population(spark):
    df = spark.createDataFrame([("3550308",), ("2304400",), ("9900000",)], "entity string")
    got = {r["entity"]: (r["state"], r["region"]) for r in add_areas(df).collect()}
    assert got == {"3550308": ("SP", "Sudeste"), "2304400": ("CE", "Nordeste"), "9900000": (None, None)}


def test_annual_mean_rounds_half_to_even(spark):
    monthly = spark.createDataFrame([("1", 2020, "s", 0.125)], "code string, year int, source string, coverage double")
    assert annual_coverage(monthly).first()["coverage"] == 0.12


def test_csv_keeps_leading_zeros(spark, tmp_path):
    path = str(tmp_path / "csv")
    write_csv(spark.createDataFrame([("007", 1)], "code string, n int"), path)
    assert tuple(read_csv(spark, path, "code string, n int").first()) == ("007", 1)
    assert read_csv(spark, path, "code string, n int", ["n"]).columns == ["n"]


def test_partitioned_tree_takes_year_from_the_path(spark, tmp_path):
    path = str(tmp_path / "tree")
    df = spark.createDataFrame([("SP", 2019, 1), ("SP", 2020, 2)], "state string, year int, n int")
    write_partitioned(df, path, ["state", "year"])
    write_partitioned(df.limit(1), path, ["state", "year"])
    assert read_tree(spark, path).count() == 2
    plan = read_tree(spark, path).filter("year = 2020")
    assert [r["n"] for r in plan.collect()] == [2]
    assert read_tree(spark, path, path_keys=False).columns == ["n"]


def test_parquet_overwrites(spark, tmp_path):
    path = str(tmp_path / "t")
    for _ in range(2):
        write_parquet(spark.range(3), path)
    assert spark.read.parquet(path).count() == 3


def test_sql_file(tmp_path):
    file = tmp_path / "q.sql"
    file.write_text("SELECT 1;\n\nSELECT 2;\n")
    assert sql_statements(file) == ["SELECT 1", "SELECT 2"]


def test_locale_csv_refuses_a_later_file_with_another_order(spark, tmp_path):
    from equigauge.sources.tables import read_locale_csv

    (tmp_path / "a.csv").write_text("﻿name;rate\nx;1,5\nx;1,5\nx;1,5\n", encoding="utf-8")
    assert read_locale_csv(spark, str(tmp_path), ["name", "rate"], {"rate": "double"}).collect() == [("x", 1.5)] * 3
    (tmp_path / "b.csv").write_text("﻿rate;name\n2,5;y\n", encoding="utf-8")
    try:
        read_locale_csv(spark, str(tmp_path), ["name", "rate"], {"rate": "double"}).collect()
    except Exception:
        return
    raise AssertionError("another order of columns was read")
