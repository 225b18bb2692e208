import datetime
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, IntegerType, LongType, StringType

from equigauge import health_study
from equigauge.operators.cohort import RAW_COLUMNS, to_bronze
from equigauge.operators.validate import reject_gate
from equigauge.sources.drifting import IncompatibleTypes, read_drifting_tree, tree_columns, tree_schema, wider
from equigauge.sources.tables import MALFORMED, UNREADABLE, split_csv, split_locale_csv
from tests.test_layers import RAW


def write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_columns_and_types_of_all_files(spark, tmp_path):
    root = str(tmp_path / "tree")
    write(spark, f"{root}/year=2019", [(1, "a", 2)], "id int, code string, small tinyint")
    write(spark, f"{root}/year=2020", [(2**40, "b", 3, 1.5)], "id bigint, code string, small int, x double")
    write(spark, f"{root}/year=2021", [("c", 7, Decimal("1.25"))], "code string, x int, paid decimal(5,2)")
    write(spark, f"{root}/year=2022", [(Decimal("9.999"), datetime.date(2022, 1, 2))], "paid decimal(9,3), day date")
    assert tree_columns(spark, root).count() == 10
    schema = tree_schema(spark, root)
    assert {f.name: f.dataType.simpleString() for f in schema} == {
        "id": "bigint", "code": "string", "small": "int", "x": "double", "paid": "decimal(9,3)", "day": "date"}
    df = read_drifting_tree(spark, root)
    got = {r["year"]: tuple(r[c] for c in ("id", "code", "small", "x", "paid", "day")) for r in df.collect()}
    assert got == {
        2019: (1, "a", 2, None, None, None),
        2020: (2**40, "b", 3, 1.5, None, None),
        2021: (None, "c", None, 7.0, Decimal("1.250"), None),
        2022: (None, None, None, None, Decimal("9.999"), datetime.date(2022, 1, 2)),
    }
    plan = df.filter("id > 5 AND year = 2020").select("code")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,5)]" in plan
    assert "year#" in plan.split("PartitionFilters")[1]
    assert set(df.filter("id > 5").select("code").inputFiles()) == set(df.inputFiles())
    assert re.search(r"ReadSchema: struct<(code:string,id:bigint|id:bigint,code:string)>", plan)


def test_types_that_do_not_meet(spark, tmp_path):
    root = str(tmp_path / "tree")
    write(spark, f"{root}/a=1", [(1,)], "id int")
    write(spark, f"{root}/a=2", [("1",)], "id string")
    with pytest.raises(IncompatibleTypes, match="column id is"):
        read_drifting_tree(spark, root)
    assert wider("x", IntegerType(), DoubleType()) == DoubleType()
    assert wider("x", DecimalType(10, 2), IntegerType()) == DecimalType(12, 2)
    for a, b in ((LongType(), DoubleType()), (DecimalType(38, 0), DecimalType(38, 10)), (StringType(), LongType())):
        with pytest.raises(IncompatibleTypes):
            wider("x", a, b)


def test_absent_raw_columns_are_null(spark):
    row = ("355030", "1", 45, "4", "E119", "0408050020", "1", 0, 1.0, 1, 2019, 1)
    raw = spark.createDataFrame([row], RAW)
    study = health_study()
    whole = to_bronze(raw, study).first()
    for name in RAW_COLUMNS:
        if name == "DIAG_PRINC":
            with pytest.raises(ValueError, match="DIAG_PRINC"):
                to_bronze(raw.drop(name), study)
            continue
        got = to_bronze(raw.drop(name), study)
        assert got.columns == list(whole.asDict()) and got.count() == 1
        changed = {k for k, v in got.first().asDict().items() if v != whole[k]}
        assert len(changed) <= 2 and (changed or name == "IDENT"), (name, changed)


def lines(tmp_path, name, *text):
    (tmp_path / name).write_bytes("\n".join(text).encode())


def test_csv_rejects(spark, tmp_path):
    lines(tmp_path, "a.csv", "code,n,x", "007,1,1.5", "008,2", "009,3,2.5,more", "010,many,1.0", '"a,b",4,', "")
    lines(tmp_path, "b.csv", "code,n,x", "011,5,bad", "012,6,6.5")
    good, rejects = split_csv(spark, str(tmp_path), "code string, n int, x double")
    assert sorted(map(tuple, good.collect()), key=str) == [("007", 1, 1.5), ("012", 6, 6.5), ("a,b", 4, None)]
    got = {(r["path"].rsplit("/")[-1], r["category"], r["record"]) for r in rejects.collect()}
    assert got == {("a.csv", MALFORMED, x) for x in ("008,2", "009,3,2.5,more", "010,many,1.0")} | {
        ("b.csv", MALFORMED, "011,5,bad")}
    # Fewer columns make no record whole.
    assert good.select("code").count() == 3 and rejects.select("path").count() == 4
    assert reject_gate(rejects, 5) is rejects
    with pytest.raises(ValueError):
        reject_gate(rejects, 4)
    lines(tmp_path, "c.csv", "n,code,x", "1,a,2.0")
    with pytest.raises(Exception, match="CSV header does not conform|FAILED_READ_FILE"):
        split_csv(spark, str(tmp_path), "code string, n int, x double")


def test_locale_csv_rejects(spark, tmp_path):
    lines(tmp_path, "a.csv", "﻿code;x;n", "007;1.234,5;1", "008;;", "009;1,5", "010;x;3", "011;1;2;3", "012; 2,5 ;n")
    good, rejects = split_locale_csv(spark, str(tmp_path), ["code", "x", "n"], {"x": "double", "n": "int"})
    assert sorted(map(tuple, good.collect())) == [("007", 1234.5, 1), ("008", None, None)]
    got = {(r["category"], r["record"]) for r in rejects.collect()}
    assert got == {(MALFORMED, "009;1,5"), (MALFORMED, "011;1;2;3"), (UNREADABLE, "010;x;3"), (UNREADABLE, "012; 2,5 ;n")}
    assert rejects.filter(F.endswith("path", F.lit("a.csv"))).count() == 4
