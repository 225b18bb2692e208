"""Folders of record files that Spark writes from the tables, read and ingested again."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from equigauge.functions.text import file_name_parts
from equigauge.operators.cohort import to_bronze
from equigauge.operators.validate import completeness_of, expected_files, missing_inputs
from equigauge.operators.rollup import SILVER_KEYS, roll_up
from equigauge.plans.catalogue.base import on_layers, query, rounded
from equigauge.session import stage_path, staged
from equigauge.sinks.cells import CellStore
from equigauge.sinks.files import BYTE_ORDER_MARK, decimal_comma
from equigauge.sinks.record_files import Field, write_named, write_record_files
from equigauge.sources.drifting import read_drifting_tree
from equigauge.sources.record_files import list_record_files, read_record_files
from equigauge.sources.tables import split_csv, split_locale_csv
from equigauge.streaming.record_ingest import (
    RecordIngest, ingest_new, ingest_stream, ingested, refresh_cells,
)

# Fields of an admission record: name, type letter, size.
FIELDS = [
    Field("MUNIC_RES", "C", 12), Field("SEXO", "C", 1), Field("IDADE", "N", 3),
    Field("COD_IDADE", "C", 1), Field("DIAG_PRINC", "C", 6), Field("PROC_REA", "C", 10),
    Field("IDENT", "C", 1), Field("MORTE", "N", 1), Field("VAL_TOT", "N", 14),
    Field("DIAS_PERM", "N", 5),
]
COLUMNS = {f.name: "number" if f.kind == "N" else "text" for f in FIELDS}
YEARS = (1970, 2069)
#: Small enough that files of the test tables have several ranges.
SMALL_RANGE = 8 << 10


def write_admissions(d) -> str:
    """The admission records as files by two letters of the region, year and month."""
    region = d.entities.select(
        F.col("code").alias("MUNIC_RES"), F.left("region", F.lit(2)).alias("_state")
    )
    two = lambda name: F.lpad((F.col(name) % 100).cast("string"), 2, "0")
    records = d.raw_with(region).withColumn(
        "_name", F.concat(F.lit("RD"), "_state", two("year"), two("month"))
    )
    path = stage_path(d.spark, "admissions")
    price = records.withColumn("VAL_TOT", F.col("VAL_TOT").cast("decimal(14,2)"))
    write_record_files(price, path, "_name", FIELDS)
    return path


def write_broken(d, path: str) -> None:
    """A file for every nation that is too short for a header."""
    month = F.lpad((F.col("n_nationkey") % 12 + 1).cast("string"), 2, "0")
    files = d.table("nation").select(
        F.concat(
            F.lit("RDZZ95"), month, F.lit(".n"), F.coalesce(F.col("n_nationkey").cast("string"), F.lit(""))
        ).alias("file"),
        F.lit("cut").alias("bytes"),
    )
    write_named(files.withColumn("file", F.coalesce("file", F.lit(""))), path, "file", "bytes")


def cohort_ingest(d, root: str, transform=None) -> RecordIngest:
    keep = lambda df: to_bronze(df, d.study)
    return RecordIngest(root, COLUMNS, transform or keep, YEARS, range_bytes=SMALL_RANGE)


@query(on_layers("""
SELECT year, month, count(*) AS cases, count_if(severe) AS severe, CAST(sum(death) AS BIGINT) AS deaths,
       round(CAST(sum(CAST(cost AS DECIMAL(18, 2))) AS DOUBLE), 2) AS cost
FROM bronze GROUP BY year, month"""))
def record_file_ranges(d) -> DataFrame:
    """The cohort from record files on disk, a file read by several ranges."""
    parts = file_name_parts(F.col("name"), YEARS)
    records = read_record_files(d.spark, write_admissions(d), COLUMNS, SMALL_RANGE, parts)
    return to_bronze(records, d.study).groupBy("year", "month").agg(
        F.count("*").alias("cases"),
        F.count_if("severe").alias("severe"),
        F.sum("death").cast("long").alias("deaths"),
        F.round(F.sum(F.col("cost").cast("decimal(18,2)")).cast("double"), 2).alias("cost"),
    )


_INGESTED = """
SELECT 'rows' AS part, CAST(year AS VARCHAR) AS label, count(*) AS n, count_if(band IS NULL) AS undefined
FROM bronze GROUP BY year
UNION ALL SELECT 'read', 'all', count(*), (SELECT count_if(band IS NULL) FROM bronze) FROM raw
UNION ALL SELECT 'rejects', 'truncated header', count(*), 0 FROM nation HAVING count(*) > 0
UNION ALL SELECT 'ledger', 'good files', count(*), 0 FROM (
  SELECT DISTINCT left(region, 2), year, month FROM raw JOIN entities USING (code))"""


def _account(d, root: str) -> DataFrame:
    """Rows, rejects, counts and ledger of an ingest as one table."""
    rows, rejects, counts, ledger = (
        ingested(d.spark, root, t) for t in ("rows", "rejects", "counts", "ledger")
    )
    shape = lambda df, part, label, n, undefined: df.select(
        F.lit(part).alias("part"), label.cast("string").alias("label"),
        n.cast("long").alias("n"), undefined.cast("long").alias("undefined"),
    )
    by_year = rows.groupBy("year").agg(
        F.count("*").alias("n"), F.count_if(F.col("band").isNull()).alias("u")
    )
    by_category = rejects.groupBy("category").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("read").alias("n"), F.sum("band_undefined").alias("u"))
    good = ledger.filter("status = 'ok'").agg(F.count("*").alias("n"))
    n, none = F.col("n"), F.lit(0)
    return (
        shape(by_year, "rows", F.col("year"), n, F.col("u"))
        .union(shape(total, "read", F.lit("all"), n, F.col("u")))
        .union(shape(by_category, "rejects", F.col("category"), n, none))
        .union(shape(good, "ledger", F.lit("good files"), n, none))
    )


@query(on_layers(_INGESTED))
def record_stream(d) -> DataFrame:
    """Record files streamed into rows, rejects, counts and ledger; the second run adds nothing."""
    source, root, log = (write_admissions(d), *(stage_path(d.spark, f"record-{n}") for n in ("out", "log")))
    write_broken(d, source)
    for _ in range(2):
        ingest_stream(d.spark, source, cohort_ingest(d, root), log, files_per_batch=400)
    return _account(d, root)


class Interrupted(RuntimeError):
    pass


@query(on_layers(_INGESTED))
def record_ledger(d) -> DataFrame:
    """The same without a stream: a run that stops within its second batch, and one that resumes."""
    source, root = write_admissions(d), stage_path(d.spark, "record-ledger")
    write_broken(d, source)
    begun = []

    def stops(df: DataFrame) -> DataFrame:
        begun.append(1)
        if len(begun) == 2:
            raise Interrupted
        return to_bronze(df, d.study)

    try:
        ingest_new(d.spark, source, cohort_ingest(d, root, stops), files_per_batch=250)
    except Interrupted:
        pass
    for _ in range(2):
        ingest_new(d.spark, source, cohort_ingest(d, root), files_per_batch=250)
    return _account(d, root)


_EXPECTED_SQL = on_layers(""", states AS (SELECT DISTINCT left(r_name, 2) AS state FROM region),
expected AS (SELECT state, year, m.month FROM states, years, (SELECT unnest(range(1, 13)) AS month) m),
held AS (SELECT DISTINCT left(region, 2) AS state, year, month FROM raw JOIN entities USING (code)),
""")


def _expected(d) -> DataFrame:
    states = sorted({r[0] for r in d.table("region").select(F.left("r_name", F.lit(2))).collect()})
    return expected_files(d.spark, states, d.study.years)


def _held(d) -> DataFrame:
    files = list_record_files(d.spark, write_admissions(d))
    return files.select(*[c.alias(k) for k, c in file_name_parts(F.col("name"), YEARS).items()])


@query(_EXPECTED_SQL.rstrip().rstrip(",") + """
SELECT state, CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month
FROM expected ANTI JOIN held USING (state, year, month)""")
def absent_record_files(d) -> DataFrame:
    """Files of the list of states, years and months that the folder does not have, by their names."""
    return missing_inputs(_expected(d), _held(d), ["state", "year", "month"])


@query(_EXPECTED_SQL.rstrip().rstrip(",") + """
SELECT expected, processed, expected - processed AS missing,
       round((expected - processed) / CAST(expected AS DOUBLE), 6) AS missing_share,
       (expected - processed) <= expected * 0.02 AS passed
FROM (SELECT (SELECT count(*) FROM expected) AS expected,
             (SELECT count(*) FROM expected SEMI JOIN held USING (state, year, month)) AS processed)""")
def record_file_completeness(d) -> DataFrame:
    """How many of the expected files the folder has."""
    keys = ["state", "year", "month"]
    expected = _expected(d)
    return rounded(completeness_of(expected, _held(d).join(expected, keys, "left_semi"), keys))


@query(on_layers("""
SELECT code, year, sex, band, cases, CAST(severe AS BIGINT) AS severe,
       CAST(deaths AS BIGINT) AS deaths, CAST(cost AS DOUBLE) AS cost,
       CAST(stay_days AS BIGINT) AS stay_days, age_sum, age_known FROM silver"""))
def incremental_silver(d) -> DataFrame:
    """Silver from parts of three batches, folded in between; the last batch comes twice."""
    cells = CellStore(d.spark, stage_path(d.spark, "silver-cells"), roll_up, SILVER_KEYS)
    batch = lambda i: d.bronze.filter(F.col("month") % 3 == i)
    cells.add(batch(0), 0)
    cells.add(batch(1), 1)
    cells.fold()
    for _ in range(2):
        cells.add(batch(2), 2)
    return rounded(cells.read(), 2, "cost")


@query(on_layers("""
SELECT year, band, CAST(sum(cases) AS BIGINT) AS cases, CAST(sum(severe) AS BIGINT) AS severe
FROM silver GROUP BY year, band"""))
def silver_of_ingest(d) -> DataFrame:
    """Record files ingested in batches, and silver brought up to date after every run."""
    source, root = write_admissions(d), stage_path(d.spark, "silver-ingest")
    cells = CellStore(d.spark, stage_path(d.spark, "ingest-cells"), roll_up, SILVER_KEYS)
    for _ in range(2):
        ingest_new(d.spark, source, cohort_ingest(d, root), files_per_batch=300)
        refresh_cells(d.spark, root, cells)
        cells.fold()
    return cells.read().groupBy("year", "band").agg(F.sum("cases").alias("cases"), F.sum("severe").alias("severe"))


@query(on_layers("""
SELECT year, count(*) AS cases, count_if(severe AND month > 6) AS severe,
       CAST(sum(stay_days) AS BIGINT) AS stay_days, max(age_years) AS oldest,
       round(CAST(sum(CAST(cost AS DECIMAL(18, 2))) AS DOUBLE), 2) AS cost
FROM bronze GROUP BY year"""))
def drifting_tree(d) -> DataFrame:
    """The cohort from a tree whose first half years lack a column and have narrower numbers."""
    path = stage_path(d.spark, "drifting")
    raw = staged(d.raw, "raw")
    types = {"IDADE": ("tinyint", "bigint"), "DIAS_PERM": ("smallint", "int"), "VAL_TOT": ("decimal(12,2)", "decimal(16,4)")}
    for half, months in enumerate(("month <= 6", "month > 6")):
        part = raw.filter(months).withColumns({n: F.col(n).cast(t[half]) for n, t in types.items()})
        part = part.drop("PROC_REA") if half == 0 else part
        part.withColumn("half", F.lit(half)).write.mode("append").partitionBy("half", "year").parquet(path)
    return to_bronze(read_drifting_tree(d.spark, path), d.study).groupBy("year").agg(
        F.count("*").alias("cases"),
        F.count_if("severe").alias("severe"),
        F.sum("stay_days").cast("long").alias("stay_days"),
        F.max("age_years").alias("oldest"),
        F.round(F.sum(F.col("cost").cast("decimal(18,2)")).cast("double"), 2).alias("cost"),
    )


_ODD_ORDERS = """
SELECT part, category, count(*) AS records, round(sum(o_totalprice), 2) AS total FROM (
  SELECT o_totalprice, CASE WHEN o_orderkey % 40 IN (0, 1) THEN 'rejects' ELSE 'rows' END AS part,
         CASE WHEN o_orderkey % 40 IN (0, 1) THEN 'malformed record' ELSE 'good' END AS category,
         o_orderkey FROM orders WHERE o_orderkey % 40 <> 2
  UNION ALL
  SELECT o_totalprice, 'rejects', '{unread}', o_orderkey FROM orders WHERE o_orderkey % 40 = 2)
GROUP BY part, category"""


def _odd_orders(d, sep: str, price, mark: str = "") -> str:
    """Orders as CSV files; some lines are short, some long, and some have no number for a price."""
    path = stage_path(d.spark, "odd-csv")
    key = F.col("o_orderkey")
    fields = [key.cast("string"), F.col("o_orderstatus"), F.when(key % 40 == 2, F.lit("many")).otherwise(price)]
    line = (
        F.when(key % 40 == 0, F.concat_ws(sep, *fields[:2]))
        .when(key % 40 == 1, F.concat_ws(sep, *fields, F.lit("more")))
        .otherwise(F.concat_ws(sep, *fields))
    )
    file = F.concat(F.lit("orders-"), F.coalesce((key % 7).cast("string"), F.lit("")), F.lit(".csv"))
    lines = d.table("orders").select(file.alias("file"), F.lit(1).alias("kind"), line.alias("line"))
    heads = lines.select("file").distinct().select(
        "file", F.lit(0).alias("kind"), F.lit(mark + sep.join(("key", "status", "price"))).alias("line")
    )
    every = heads.unionByName(lines).withColumn("file", F.coalesce("file", F.lit("")))
    write_named(every, path, "file", "line", "kind")
    return path


def _split_counts(d, good: DataFrame, rejects: DataFrame) -> DataFrame:
    prices = d.table("orders").select(F.col("o_orderkey").alias("key"), "o_totalprice")
    keyed = rejects.withColumn("key", F.regexp_extract("record", r"^(\d+)", 1).cast("long")).join(prices, "key")
    shape = lambda df, part, category, value: df.groupBy(
        F.lit(part).alias("part"), category.alias("category")
    ).agg(F.count("*").alias("records"), F.round(F.sum(value), 2).alias("total"))
    return shape(good, "rows", F.lit("good"), "price").union(
        shape(keyed, "rejects", F.col("category"), "o_totalprice")
    )


@query("""
SELECT part, category, CAST(sum(records) AS BIGINT) AS records, round(sum(total), 2) AS total
FROM (""" + _ODD_ORDERS.format(unread="malformed record") + ") GROUP BY part, category")
def csv_rejects(d) -> DataFrame:
    """Good and malformed records of CSV files, apart, from one read."""
    path = _odd_orders(d, ",", F.col("o_totalprice").cast("string"))
    return _split_counts(d, *split_csv(d.spark, path, "key bigint, status string, price double"))


@query(_ODD_ORDERS.format(unread="unreadable number"))
def locale_csv_rejects(d) -> DataFrame:
    """The same of files with decimal commas and a byte-order mark."""
    path = _odd_orders(d, ";", decimal_comma(F.col("o_totalprice")), BYTE_ORDER_MARK)
    good, rejects = split_locale_csv(
        d.spark, path, ["key", "status", "price"], {"key": "bigint", "price": "double"}
    )
    return _split_counts(d, good, rejects)
