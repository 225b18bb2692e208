"""Sources and sinks, fed with files and documents that Spark derives from the tables."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, functions as F

from equigauge.config import CENSUS_GROUPS_BY_BAND, SEX_BY_CENSUS_CODE, STATE_BY_CODE
from equigauge.operators.cohort import to_bronze
from equigauge.operators.validate import completeness_of, missing_inputs, reject_summary
from equigauge.plans import reports
from equigauge.plans.catalogue.base import on_layers, query, rounded
from equigauge.plans.workload import entity_code, full_code
from equigauge.sinks.files import (
    write_csv, write_locale_csv, write_parquet, write_partitioned,
)
from equigauge.session import spread, stage_path
from equigauge.sources.fixed_width import decode_files, file_headers
from equigauge.sources.nested import (
    crosstab_to_long, flatten_census, read_census, read_coverage, read_crosstab, regroup_bands,
)
from equigauge.sources.tables import read_csv, read_locale_csv, read_tree, sql_statements
from equigauge.streaming.ingest import ingest, ingest_counted, ingest_counts, stream_files

RECORD_COLUMNS = {"CODE": "text", "STATUS": "text", "PRICE": "number"}
SQL_FILE = Path(__file__).parents[1] / "order_counts.sql"


@query(on_layers("""
SELECT year, month, count(*) AS cases, count_if(severe) AS severe
FROM bronze GROUP BY year, month"""))
def partitioned_tree(d) -> DataFrame:
    """The cohort layer written as a tree by year, and read back with year from the path."""
    path = stage_path(d.spark, "tree")
    write_partitioned(d.bronze, path, ["year"])
    return read_tree(d.spark, path).groupBy("year", "month").agg(
        F.count("*").alias("cases"), F.count_if("severe").alias("severe")
    )


@query(on_layers("""
SELECT sex, count(*) AS cells, CAST(sum(cases) AS BIGINT) AS cases
FROM events GROUP BY sex"""))
def parquet_overwrite(d) -> DataFrame:
    """The event cells written and read back as parquet."""
    path = stage_path(d.spark, "events")
    write_parquet(d.events, path)
    return d.spark.read.parquet(path).groupBy("sex").agg(
        F.count("*").alias("cells"), F.sum("cases").alias("cases")
    )


@query("""
SELECT lpad(CAST(o_custkey AS VARCHAR), 12, '0') AS code, count(*) AS orders,
       round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY 1""")
def csv_pinned_types(d) -> DataFrame:
    """A CSV whose codes keep their leading zeros, written and read back."""
    path = stage_path(d.spark, "csv")
    write_csv(
        d.table("orders").select(
            entity_code(F.col("o_custkey")).alias("code"), "o_orderkey", "o_totalprice"
        ),
        path,
    )
    df = read_csv(
        d.spark, path, "code string, o_orderkey bigint, o_totalprice double",
        columns=["code", "o_totalprice"],
    )
    return df.groupBy("code").agg(
        F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query("""
SELECT o_orderstatus AS status, count(*) AS orders, round(sum(o_totalprice), 2) AS total,
       round(sum(o_totalprice * 1000000), 0) AS large, count_if(o_orderkey % 7 = 0) AS missing
FROM orders GROUP BY 1""")
def locale_csv(d) -> DataFrame:
    """Decimal commas and a byte-order mark, written and read back."""
    path = stage_path(d.spark, "locale")
    price = F.col("o_totalprice")
    columns = ["status", "price", "large", "partial"]
    write_locale_csv(
        d.table("orders").select(
            F.col("o_orderstatus").alias("status"),
            price.alias("price"),
            (price * 1000000).alias("large"),
            F.when(F.col("o_orderkey") % 7 != 0, price).alias("partial"),
        ),
        path,
    )
    back = read_locale_csv(
        d.spark, path, columns, {"price": "double", "large": "double", "partial": "double"}
    )
    return back.groupBy("status").agg(
        F.count("*").alias("orders"),
        F.round(F.sum("price"), 2).alias("total"),
        F.round(F.sum("large"), 0).alias("large"),
        F.count_if(F.col("partial").isNull()).alias("missing"),
    )


# Fields of the record files below: name, type letter, size.
_RECORD_FIELDS = (("CODE", "C", 12), ("STATUS", "C", 3), ("PRICE", "N", 14), ("UNREAD", "C", 5))
_FILE_KEYS = 500


def _low_bytes(value: Column, size: int) -> Column:
    """Little-endian bytes of a whole number."""
    big_endian = F.lpad(F.hex(value), 2 * size, "0")
    return F.unhex(
        F.concat(*[F.substring(big_endian, 2 * (size - i) - 1, 2) for i in range(size)])
    )


def record_files(d) -> DataFrame:
    """Orders as fixed-width files of 500 keys each; every seventh file is cut off."""
    header_length = 32 + 32 * len(_RECORD_FIELDS) + 1
    record_length = 1 + sum(size for _, _, size in _RECORD_FIELDS)
    descriptors = b"".join(
        name.encode().ljust(11, b"\0") + kind.encode() + b"\0" * 4 + bytes([size]) + b"\0" * 15
        for name, kind, size in _RECORD_FIELDS
    )
    record = F.concat(
        F.when(F.col("o_orderkey") % 10 == 0, F.lit("*")).otherwise(F.lit(" ")),
        entity_code(F.col("o_custkey")),
        F.rpad("o_orderstatus", 3, " "),
        F.lpad(F.col("o_totalprice").cast("decimal(14,2)").cast("string"), 14, " "),
        F.lit("xxxxx"),
    )
    files = (
        d.table("orders")
        .select(F.floor(F.col("o_orderkey") / _FILE_KEYS).alias("file"), record.alias("record"))
        # The order key is unique, so a file holds at most 500 records.
        .groupBy("file")
        .agg(F.array_join(F.collect_list("record"), "").alias("body"), F.count("*").alias("n"))
    )
    content = F.concat(
        F.lit(b"\x03\x18\x01\x01"),
        # One record more than there are, as some files declare.
        _low_bytes(F.col("n") + 1, 4),
        _low_bytes(F.lit(header_length), 2),
        _low_bytes(F.lit(record_length), 2),
        F.lit(b"\0" * 20 + descriptors + b"\x0d"),
        F.encode("body", "ISO-8859-1"),
        F.lit(b"\x1a"),
    )
    cut = F.when(F.col("file") % 7 == 6, F.substring(content, 1, 20)).otherwise(content)
    return files.select(F.concat(F.lit("file-"), "file").alias("path"), cut.alias("content"))


@query(f"""
SELECT lpad(CAST(o_custkey AS VARCHAR), 12, '0') AS code, o_orderstatus AS status,
       count(*) AS records, round(sum(o_totalprice), 2) AS total
FROM orders WHERE o_orderkey % 10 <> 0 AND floor(o_orderkey / {_FILE_KEYS}) % 7 <> 6
GROUP BY 1, 2""")
def fixed_width_records(d) -> DataFrame:
    """Records of many fixed-width files; deleted ones and broken files are left out."""
    records = decode_files(record_files(d), RECORD_COLUMNS)
    return records.groupBy(F.col("CODE").alias("code"), F.col("STATUS").alias("status")).agg(
        F.count("*").alias("records"), F.round(F.sum("PRICE"), 2).alias("total")
    )


@query(f"""
WITH f AS (SELECT DISTINCT floor(o_orderkey / {_FILE_KEYS}) AS file FROM orders)
SELECT 'truncated header' AS category, count(*) AS files, count(*) >= 60 AS aborted
FROM f WHERE file % 7 = 6 HAVING count(*) > 0""")
def rejected_files(d) -> DataFrame:
    """Broken files by category, and the verdict of the gate."""
    return reject_summary(file_headers(record_files(d)), limit=60)


@query(f"""
WITH f AS (SELECT DISTINCT CAST(floor(o_orderkey / {_FILE_KEYS}) AS BIGINT) AS file FROM orders),
n AS (SELECT count(*) AS expected, count_if(file % 7 <> 6) AS processed FROM f)
SELECT expected, processed, expected - processed AS missing,
       round((expected - processed) / CAST(expected AS DOUBLE), 6) AS missing_share,
       (expected - processed) <= expected * 0.02 AS passed FROM n""")
def file_completeness(d) -> DataFrame:
    """Expected files against readable ones."""
    headers = file_headers(record_files(d)).select("path", "status")
    return rounded(
        completeness_of(headers, headers.filter("status = 'ok'"), ["path"])
    )


@query(f"""
SELECT DISTINCT 'file-' || CAST(CAST(floor(o_orderkey / {_FILE_KEYS}) AS BIGINT) AS VARCHAR) AS path
FROM orders WHERE CAST(floor(o_orderkey / {_FILE_KEYS}) AS BIGINT) % 7 = 6""")
def missing_files(d) -> DataFrame:
    headers = file_headers(record_files(d)).select("path", "status")
    return missing_inputs(headers.select("path"), headers.filter("status = 'ok'"), ["path"])


_CENSUS_GROUPS = [g for groups in CENSUS_GROUPS_BY_BAND.values() for g in groups]
_GROUP_ROWS = ", ".join(
    f"({k}, '{band}')"
    for k, band in enumerate(b for b, groups in CENSUS_GROUPS_BY_BAND.items() for _ in groups)
)


def _census_documents(d) -> DataFrame:
    """One census response per customer, as JSON text."""
    sexes = list(SEX_BY_CENSUS_CODE)
    keys = F.array(
        *[
            F.struct(
                F.lit(s).alias("sex"), F.lit(i).alias("s"),
                F.lit(str(g)).alias("grp"), F.lit(k).alias("k"),
            )
            for i, s in enumerate(sexes)
            for k, g in enumerate(_CENSUS_GROUPS)
        ]
    )
    key = F.col("c_custkey")

    def result(c: Column) -> Column:
        people = (key * 7 + c["k"] * 13 + c["s"] * 5) % 90
        value = F.when((key + c["k"]) % 17 == 0, F.lit("-")).otherwise(people.cast("string"))
        category = lambda code: F.struct(F.create_map(code, F.lit("label")).alias("categoria"))
        return F.struct(
            F.array(category(c["sex"]), category(c["grp"])).alias("classificacoes"),
            F.array(
                F.struct(
                    F.struct(full_code(key).alias("id")).alias("localidade"),
                    F.create_map(F.lit("2022"), value).alias("serie"),
                )
            ).alias("series"),
        )

    response = F.array(F.struct(F.transform(keys, result).alias("resultados")))
    # One short row becomes a document of all groups, which is then written and parsed.
    return spread(d.table("customer").select("c_custkey")).select(F.to_json(response).alias("json"))


_CENSUS_SQL = on_layers(f""", groups(k, band) AS (VALUES {_GROUP_ROWS})
SELECT entity, CASE s.s WHEN 0 THEN 'M' ELSE 'F' END AS sex, g.band,
       CAST(sum(CASE WHEN (c_custkey + k) % 17 = 0 THEN 0
                     ELSE (c_custkey * 7 + k * 13 + s * 5) % 90 END) AS BIGINT) AS population
FROM entities, (VALUES (0), (1)) s(s), groups g GROUP BY 1, 2, 3""")


@query(_CENSUS_SQL)
def census_bands(d) -> DataFrame:
    """Nested census responses to population by band; unreadable values count as zero."""
    return regroup_bands(flatten_census(_census_documents(d)))


@query(_CENSUS_SQL)
def census_files(d) -> DataFrame:
    """The same from files, a response on each line."""
    path = stage_path(d.spark, "census")
    _census_documents(d).write.text(path)
    return regroup_bands(read_census(d.spark, path, whole_files=False))


@query(on_layers("""
SELECT code, year, source, CAST(sum(hundredths) AS BIGINT) AS hundredths, count(*) AS months
FROM coverage_monthly GROUP BY code, year, source"""))
def coverage_files(d) -> DataFrame:
    """Coverage records written as JSON and read by path."""
    path = stage_path(d.spark, "coverage")
    d.coverage_records.write.json(path)
    return read_coverage(d.spark, path).groupBy("code", "year", "source").agg(
        F.sum(F.round(F.col("coverage") * 100).cast("long")).alias("hundredths"),
        F.count("*").alias("months"),
    )


@query(on_layers("""
SELECT entity, year, source, round(coverage, 6) AS coverage FROM coverage"""))
def coverage_two_layouts(d) -> DataFrame:
    """Two coverage series with their own fields and date layouts to yearly means."""
    return rounded(d.coverage.select("entity", "year", "source", "coverage"))


_AREA_BY_NATION = dict(enumerate(list(STATE_BY_CODE)[:25]))
_AREA_ROWS = ", ".join(f"({i}, '{STATE_BY_CODE[c]}')" for i, c in _AREA_BY_NATION.items())


_CROSSTAB_SQL = on_layers(f""", areas(n, code) AS (VALUES {_AREA_ROWS})
SELECT a.code AS state, y.year, count(o_orderkey) AS cases
FROM areas a CROSS JOIN years y
JOIN customer ON c_nationkey = a.n
LEFT JOIN orders ON o_custkey = c_custkey AND year(o_orderdate) = y.year
GROUP BY 1, 2""")



def _crosstab_texts(d) -> DataFrame:
    """Crosstab texts, areas down and years across, with dashes and thousands marks."""
    years = d.study.years
    of_customer = (
        d.table("orders")
        .groupBy("o_custkey")
        .agg(*[F.count_if(F.year("o_orderdate") == y).alias(str(y)) for y in years])
    )
    counts = (
        of_customer.join(d.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey")
        .agg(*[F.sum(str(y)).alias(str(y)) for y in years])
    )
    area = F.try_element_at(
        F.create_map(*[F.lit(v) for kv in _AREA_BY_NATION.items() for v in kv]), "c_nationkey"
    )
    cell = lambda y: F.when(F.col(str(y)) == 0, F.lit("-")).otherwise(
        F.translate(F.format_number(F.col(str(y)), 0), ",", ".")
    )
    quoted = lambda *parts: F.concat(F.lit('"'), F.array_join(F.array(*parts), '";"'), F.lit('"'))
    line = quoted(F.concat(area.cast("string"), F.lit(" Area")), *[cell(y) for y in years])
    # One line per nation (a fixed list of 25), in one text per nation key modulo five.
    return counts.groupBy((F.col("c_nationkey") % 5).alias("part")).agg(
        F.concat(
            F.lit("Title line\n"),
            quoted(F.lit("Area"), *[F.lit(str(y)) for y in years], F.lit("Total")),
            F.lit("\r\n"),
            F.array_join(F.collect_list(line), "\n"),
            F.lit('\n"Total";"1";"2"\nfoot note'),
        ).alias("value")
    )


@query(_CROSSTAB_SQL)
def crosstab_totals(d) -> DataFrame:
    """Crosstab text to rows."""
    return crosstab_to_long(_crosstab_texts(d))


@query(_CROSSTAB_SQL)
def crosstab_files(d) -> DataFrame:
    """The same from files, one text in each."""
    path = stage_path(d.spark, "crosstab")
    _crosstab_texts(d).write.partitionBy("part").text(path)
    return read_crosstab(d.spark, path)


@query("""
SELECT o_orderpriority AS priority, count(*) AS orders,
       CAST(min(o_orderdate) AS DATE) AS first_day
FROM orders GROUP BY o_orderpriority
UNION ALL
SELECT o_orderstatus, count(*), CAST(min(o_orderdate) AS DATE) FROM orders GROUP BY o_orderstatus""")
def sql_file_statements(d) -> DataFrame:
    """Two statements of an SQL file, run one after another and put together."""
    first, second = (
        d.spark.sql(text, orders=d.table("orders")) for text in sql_statements(SQL_FILE)
    )
    return first.union(second)


@query(on_layers("""
SELECT year, CAST(sum(cases) AS BIGINT) AS cases, CAST(sum(severe) AS BIGINT) AS severe,
       CAST(sum(deaths) AS BIGINT) AS deaths, round(CAST(sum(cost) AS DOUBLE), 2) AS cost,
       round(CAST(100 AS DOUBLE) * sum(severe) / nullif(sum(cases), 0), 2) AS severe_pct,
       round(CAST(100 AS DOUBLE) * sum(deaths) / nullif(sum(cases), 0), 2) AS death_pct
FROM gold GROUP BY year ORDER BY year"""))
def sql_national_panorama(d) -> DataFrame:
    """Totals and shares by year."""
    return reports.national_panorama(d.cells())


@query(on_layers("""
SELECT region, year, CAST(sum(cases) AS BIGINT) AS cases,
       CAST(sum(population) AS BIGINT) AS population,
       round(CAST(100000 AS DOUBLE) * sum(cases) / nullif(sum(population), 0), 1) AS crude_rate
FROM gold GROUP BY region, year"""))
def sql_region_rates(d) -> DataFrame:
    """Crude rates by region and year."""
    return reports.region_rates(d.cells())


@query(on_layers("""
SELECT region, CASE WHEN year = 1996 THEN '1996' WHEN year IN (1997, 1998) THEN '1997-98'
                    ELSE '1999-01' END AS block,
       round(CAST(100000 AS DOUBLE) * sum(cases) / nullif(sum(population), 0), 1) AS crude_rate,
       round(CAST(100 AS DOUBLE) * sum(severe) / nullif(sum(cases), 0), 2) AS severe_pct
FROM gold GROUP BY 1, 2"""))
def sql_region_blocks(d) -> DataFrame:
    """Rates and shares by region and block of years."""
    return reports.region_blocks(d.cells(), d.study)


@query(on_layers("""
SELECT region, sex, CAST(sum(cases) AS BIGINT) AS cases,
       round(CAST(100 AS DOUBLE) * sum(severe) / nullif(sum(cases), 0), 2) AS severe_pct,
       round(CAST(100 AS DOUBLE) * sum(deaths) / nullif(sum(cases), 0), 2) AS death_pct
FROM gold GROUP BY region, sex"""))
def sql_sex_by_region(d) -> DataFrame:
    """Shares by region and sex."""
    return reports.sex_by_region(d.cells())


@query(on_layers("""
SELECT entity, state, region, CAST(sum(cases) AS BIGINT) AS cases,
       CAST(sum(severe) AS BIGINT) AS severe,
       round(CAST(100 AS DOUBLE) * sum(severe) / nullif(sum(cases), 0), 2) AS severe_pct
FROM gold GROUP BY entity, state, region HAVING sum(cases) >= 20
ORDER BY severe_pct DESC NULLS LAST, entity LIMIT 50"""))
def sql_top_severe(d) -> DataFrame:
    """Entities with the highest share of severe cases."""
    return reports.top_severe(d.cells(), d.study)


@query("""
SELECT event_type, CAST(day(ts) AS INTEGER) AS day, count(*) AS events,
       round(sum(value), 4) AS value
FROM events GROUP BY 1, 2""")
def stream_ingest(d) -> DataFrame:
    """Event files streamed into a table twice; the second run finds nothing new."""
    schema = d.table("events").schema
    path, log = stage_path(d.spark, "stream"), stage_path(d.spark, "stream-log")
    shape = lambda df: df.select("event_type", F.dayofmonth("ts").alias("day"), "value")
    for _ in range(2):
        ingest(
            stream_files(d.spark, d.sf_dir, schema, name_filter="events.parquet"),
            shape, path, log, partition_by=["event_type"],
        )
    return d.spark.read.parquet(path).groupBy("event_type", "day").agg(
        F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value")
    )


@query(on_layers("""
SELECT year, band, count(*) AS cases, count_if(severe) AS severe, CAST(sum(death) AS BIGINT) AS deaths
FROM bronze GROUP BY year, band"""))
def stream_cohort(d) -> DataFrame:
    """The cohort transform on a stream of record files."""
    source, path, log = (stage_path(d.spark, n) for n in ("records", "cohort", "cohort-log"))
    write_partitioned(d.raw, source, ["year"])
    records = stream_files(d.spark, source, d.raw.schema)
    ingest(records, lambda df: to_bronze(df, d.study), path, log, partition_by=["year"])
    return read_tree(d.spark, path).groupBy("year", "band").agg(
        F.count("*").alias("cases"),
        F.count_if("severe").alias("severe"),
        F.sum("death").alias("deaths"),
    )


@query(on_layers("""
SELECT r.year, count(*) AS read, coalesce(max(k.kept), 0) AS kept,
       coalesce(max(k.undefined), 0) AS band_undefined
FROM raw r LEFT JOIN (
  SELECT year, count(*) AS kept, count_if(band IS NULL) AS undefined FROM bronze GROUP BY year) k
  ON r.year = k.year
GROUP BY r.year"""))
def stream_counts(d) -> DataFrame:
    """Rows read, kept and without a band, counted over all batches of two runs."""
    names = ("records", "cohort", "marks", "log")
    source, path, marks, log = (stage_path(d.spark, f"counted-{n}") for n in names)
    write_partitioned(d.raw, source, ["year"])
    for _ in range(2):
        records = stream_files(d.spark, source, d.raw.schema, files_per_batch=4)
        ingest_counted(records, lambda df: to_bronze(df, d.study), path, marks, log, ["year"])
    return ingest_counts(d.spark.read.parquet(marks), d.spark.read.parquet(path), ["year"])
