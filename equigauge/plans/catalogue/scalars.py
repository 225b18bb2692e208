"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from equigauge.config import STATE_BY_CODE, STATES_BY_REGION
from equigauge.functions.codes import region_of_state, state_of_code
from equigauge.functions.labels import change_label, name_with_state
from equigauge.functions.numeric import clip, half_even, ratio, whole
from equigauge.functions.text import (
    clean_upper, file_name_parts, lenient_double, locale_double, strip, year_of_period, zero_pad,
)
from equigauge.plans.catalogue.base import on_layers, query, rounded

_STATE_ROWS = ", ".join(f"({c}, '{s}')" for c, s in STATE_BY_CODE.items())
_REGION_ROWS = ", ".join(
    f"('{s}', '{r}')" for r, states in STATES_BY_REGION.items() for s in states
)


@query("""
SELECT upper(p_type) AS cleaned, lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded,
       count(*) AS parts
FROM part GROUP BY 1, 2""")
def text_cleaning(d) -> DataFrame:
    """White space of any kind stripped, upper case, zero padding."""
    dirty = d.table("part").select(
        F.concat(F.lit("\t "), F.lower("p_type"), F.lit(" \n")).alias("text"),
        F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit("\r")).alias("number"),
    )
    return dirty.groupBy(
        clean_upper(F.col("text")).alias("cleaned"), zero_pad(F.col("number"), 4).alias("padded")
    ).agg(F.count("*").alias("parts"))


@query("""
SELECT CAST(year(o_orderdate) AS INTEGER) AS year,
       round(sum(CASE WHEN o_orderkey % 11 <> 0 THEN round(o_totalprice, 2) END), 2) AS total,
       count_if(o_orderkey % 11 = 0) AS unreadable
FROM orders GROUP BY 1""")
def lenient_numbers(d) -> DataFrame:
    """Numbers in text, some of them unreadable in various ways."""
    key = F.col("o_orderkey")
    text = (
        F.when(key % 11 != 0, F.concat(F.lit(" "), F.col("o_totalprice").cast("string")))
        .when(key % 3 == 0, F.lit("nan"))
        .when(key % 3 == 1, F.lit("12f"))
        .otherwise(F.lit("n/a"))
    )
    number = lenient_double(F.col("text"))
    return (
        d.table("orders")
        .select(F.year("o_orderdate").alias("year"), text.alias("text"))
        .select("year", number.alias("number"))
        .groupBy("year")
        .agg(
            F.round(F.sum("number"), 2).alias("total"),
            F.count_if(F.col("number").isNull()).alias("unreadable"),
        )
    )


@query("""
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, round(sum(o_totalprice), 2) AS total,
       min(o_totalprice) AS smallest, max(o_totalprice) AS largest
FROM orders GROUP BY 1""")
def locale_numbers(d) -> DataFrame:
    """Amounts as ``1.234,56`` or ``1234.56``, read back by one expression."""
    amount = F.col("o_totalprice")
    grouped = F.translate(F.format_number(amount, 2), ",.", ".,")
    text = F.when(F.col("o_orderkey") % 2 == 0, grouped).otherwise(amount.cast("string"))
    return (
        d.table("orders")
        .select(F.year("o_orderdate").alias("year"), locale_double(text).alias("amount"))
        .groupBy("year")
        .agg(
            F.round(F.sum("amount"), 2).alias("total"),
            F.min("amount").alias("smallest"),
            F.max("amount").alias("largest"),
        )
    )


@query("""
SELECT CASE WHEN year(o_orderdate) <= 1998 THEN 'compact' ELSE 'slashed' END AS layout,
       CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS records
FROM orders GROUP BY 1, 2""")
def mixed_periods(d) -> DataFrame:
    """Both period layouts to a year."""
    return d.coverage_records.groupBy(
        F.when(F.contains("nuComp", F.lit("/")), "slashed").otherwise("compact").alias("layout"),
        year_of_period(F.col("nuComp")).alias("year"),
    ).agg(F.count("*").alias("records"))


@query(f"""
WITH states(area, state) AS (VALUES {_STATE_ROWS}), regions(state, region) AS (VALUES {_REGION_ROWS})
SELECT s.state, r.region, count(*) AS customers
FROM customer c LEFT JOIN states s ON s.area = 11 + c.c_custkey % 45
LEFT JOIN regions r USING (state) GROUP BY 1, 2""")
def area_codes(d) -> DataFrame:
    """State from a code prefix, region from the state; unknown prefixes have neither."""
    code = F.concat((F.col("c_custkey") % 45 + 11).cast("string"), F.lpad("c_custkey", 5, "0"))
    states = d.table("customer").select(state_of_code(code).alias("state"))
    return states.groupBy("state", region_of_state(F.col("state")).alias("region")).agg(
        F.count("*").alias("customers")
    )


@query("""
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
       n_name AS state, count(*) AS files
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE year(o_orderdate) >= 2000 AND o_orderkey % 10 <> 0
GROUP BY 1, 2, 3""")
def file_names(d) -> DataFrame:
    """State, year and month from file names; names of other kinds and old years drop out."""
    # Orders of one customer and month count as one row before they meet the customers.
    months = (
        d.table("orders")
        .groupBy(
            "o_custkey",
            F.date_format("o_orderdate", "yyMM").alias("ending"),
            (F.col("o_orderkey") % 10 == 0).alias("other"),
        )
        .agg(F.count("*").alias("n"))
    )
    state = F.lpad("c_nationkey", 2, "0")
    named = (
        months.join(d.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(d.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "n_name",
            "n",
            F.when(F.col("other"), F.concat(F.lit("XX"), "ending"))
            .otherwise(F.concat(F.lit("rd"), state, "ending", F.lit(".dbc")))
            .alias("file"),
        )
    )
    parts = file_name_parts(F.col("file"), (2000, 2001))
    return (
        named.select("n_name", "n", parts["year"].alias("year"), parts["month"].alias("month"))
        .filter(F.col("year").isNotNull())
        .groupBy("year", "month", F.col("n_name").alias("state"))
        .agg(F.sum("n").alias("files"))
    )


@query("""
SELECT l_returnflag, CAST(sum(round(l_quantity * 4 / 8)) AS BIGINT) AS half_up,
       CAST(sum(round_even(l_quantity * 4 / 8, 0)) AS BIGINT) AS half_even
FROM lineitem GROUP BY l_returnflag""")
def rounding_rules(d) -> DataFrame:
    """Half-up rounding of SQL against half-even rounding of published tables."""
    x = F.col("l_quantity") * 4 / 8
    return d.table("lineitem").groupBy("l_returnflag").agg(
        F.sum(F.round(x).cast("long")).alias("half_up"), F.sum(whole(x)).alias("half_even")
    )


@query("""
SELECT l_linestatus, round(sum(CASE WHEN l_quantity <> 13 THEN
         least(greatest(l_quantity, 5), 40) END), 2) AS clipped,
       count_if(l_quantity = 13) AS missing
FROM lineitem GROUP BY 1""")
def clipped_values(d) -> DataFrame:
    """Clipping leaves missing values missing."""
    x = F.nullif(F.col("l_quantity"), F.lit(13.0))
    held = clip(x, F.lit(5.0), F.lit(40.0))
    return d.table("lineitem").groupBy("l_linestatus").agg(
        F.round(F.sum(held), 2).alias("clipped"), F.count_if(held.isNull()).alias("missing")
    )


@query("""
SELECT c_mktsegment, round(sum(c_acctbal) / nullif(sum(c_custkey * 0), 0), 6) AS by_zero,
       round(100 * sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 6)
         AS negative_pct
FROM customer GROUP BY 1""")
def safe_ratios(d) -> DataFrame:
    """Ratios are null, not an error, when the denominator is zero."""
    out = d.table("customer").groupBy("c_mktsegment").agg(
        ratio(F.sum("c_acctbal"), F.sum(F.col("c_custkey") * 0)).alias("by_zero"),
        ratio(F.count_if(F.col("c_acctbal") < 0), F.count("*"), 100.0).alias("negative_pct"),
    )
    return rounded(out)


@query(on_layers("""
SELECT entity, CASE WHEN c_custkey % 50 <> 0 THEN name || ' (' || state || ')' END AS label,
       CASE WHEN c_acctbal > 0 THEN 'Piorou' WHEN c_acctbal < 0 THEN 'Melhorou'
            ELSE 'Estavel' END AS direction
FROM entities"""))
def text_labels(d) -> DataFrame:
    """Joined labels are null when a part is; signs get a word."""
    name = F.when(F.col("c_custkey") % 50 != 0, strip(F.col("name")))
    return d.entities.select(
        "entity",
        name_with_state(name, F.col("state")).alias("label"),
        change_label(half_even(F.col("c_acctbal"), 4)).alias("direction"),
    )
