"""Mixing sources to target weights by capped water-filling.

Built-in functions only. Every source's target is its share of the mix by weight, at most
``max_epochs`` times its own size; what a capped source leaves is shared again by weight. A
document is then repeated whole as often as its source's rate has whole epochs, and a seeded
order decides which documents of the source get one repetition more. The document at the edge
gets the fraction of a repetition that is left, so a source takes its target to the word.

The order inside a source is a hash of seed and id. Its prefix sums are found in two steps, over
the sums of 4,096 hash buckets and then over the keys of the one bucket that holds the edge, so
no task sees all rows of a source, whatever its share.

Defined cases: a null text has size 0; a null source is a source of its own, the last in order;
documents with the same id share one place in the order, and if that is at the edge they share
the rest in proportion to their sizes; an empty table gives an empty result; other columns of
the input are left alone and never clash, because the work is done on renamed copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equigauge.llm.common import read_table, staged, word_count

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MAX_EPOCHS = 2
SEED = "mix-1"
#: Source plans up to this many rows are broadcast; more are joined by salted keys.
BROADCAST_SOURCES = 10_000
SALTS = 64


def source_key(source: Column) -> Column:
    """A key without nulls that sorts by code point, a null source last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def order_key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def water_fill(
    sizes: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share_percent: int = SHARE_PERCENT,
    max_epochs: int = MAX_EPOCHS,
) -> DataFrame:
    """(skey, source_size) -> also target: least(weight * level, max_epochs * source_size).

    The level is the one at which all targets add up to the mix. Sources are taken in the order
    in which a rising level caps them; the first that is not capped by the level of the weights
    left fixes it. One row per source, so the windows are over a table of sources, not of rows.
    """
    everything = Window.partitionBy()
    ranked = sizes.withColumn(
        "place", F.row_number().over(Window.partitionBy().orderBy("skey")) - 1
    ).withColumn(
        "weight",
        F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")),
    )
    rising = Window.partitionBy().orderBy("ratio", "place")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    after = rising.rowsBetween(0, Window.unboundedFollowing)
    levels = (
        ranked.withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * share_percent / F.lit(100.0))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(after))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
        .withColumn("at", F.row_number().over(rising))
        .withColumn(
            "level",
            F.min_by(
                F.when(F.col("level") <= F.col("ratio"), F.col("level")),
                F.when(F.col("level") <= F.col("ratio"), F.col("at")),
            ).over(everything),
        )
    )
    cap = F.col("cap").cast("double")
    return levels.select(
        "skey",
        "source_size",
        F.coalesce(F.least(F.col("weight") * F.col("level"), cap), cap).alias("target"),
    )


def mix_plan(sized: DataFrame, seed: str = SEED, **limits) -> DataFrame:
    """One row per source of ``sized`` (skey, key, size): its epochs and the edge of the order.

    Below ``edge_key`` a document is taken ``whole`` + 1 times, above it ``whole`` times, and the
    documents at it share ``rest`` words more in proportion to ``edge_size``.
    """
    buckets = sized.groupBy("skey", F.substring("key", 1, 3).alias("bucket")).agg(
        F.sum("size").alias("size")
    )
    targets = water_fill(buckets.groupBy("skey").agg(F.sum("size").alias("source_size")), **limits)
    wanted = F.floor(F.col("target") + 0.5).cast("long")
    size = F.col("source_size")
    plan = targets.withColumn(
        "whole", F.when(size > 0, F.expr("floor(target + 0.5) div source_size")).otherwise(0)
    ).withColumn("extra", wanted - F.col("whole") * size)

    def edge(pieces: DataFrame, by: str) -> DataFrame:
        """The piece in which the running size passes what is wanted."""
        running = Window.partitionBy("skey").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
        return (
            pieces.withColumn("upto", F.sum("size").over(running))
            .withColumn("rest", F.col("extra") - (F.col("upto") - F.col("size")))
            .filter((F.col("rest") >= 0) & (F.col("upto") > F.col("extra")))
            .groupBy("skey")
            .agg(
                F.min(by).alias(f"edge_{by}"),
                F.min_by("rest", by).alias("rest"),
                F.min_by("size", by).alias("edge_size"),
            )
        )

    at = edge(buckets.join(plan.select("skey", "extra"), "skey"), "bucket")
    inside = (
        sized.withColumn("bucket", F.substring("key", 1, 3))
        .join(
            at.select("skey", F.col("edge_bucket").alias("bucket"), F.col("rest").alias("extra")),
            ["skey", "bucket"],
        )
        .groupBy("skey", "key", "extra")
        .agg(F.sum("size").alias("size"))
    )
    return plan.join(edge(inside, "key"), "skey", "left").select(
        "skey", "source_size", "target", "whole", "edge_key", "rest", "edge_size"
    )


def taken(size: Column, key: Column) -> Column:
    more = (
        F.when(key < F.col("edge_key"), size)
        .when(key == F.col("edge_key"), F.expr("(size * rest) div edge_size"))
        .otherwise(0)
    )
    return F.col("whole") * size + F.coalesce(more, F.lit(0))


def join_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with their source's plan: broadcast where its counted size allows, else salted."""
    plan = staged(plan, "mix-plan")
    if plan.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(plan), "skey")
    salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (
        rows.withColumn("salt", F.pmod(F.hash("key"), F.lit(SALTS)))
        .join(salted, ["skey", "salt"])
        .drop("salt")
    )


def mix(docs: DataFrame, seed: str = SEED, **limits) -> DataFrame:
    """doc_id, size, source_size, target and taken words of every document."""
    sized = staged(
        docs.select(
            "doc_id",
            source_key(F.col("source")).alias("skey"),
            order_key(F.col("doc_id"), seed).alias("key"),
            word_count(F.col("text")).alias("size"),
        ),
        "mix-sizes",
    )
    return join_plan(sized, mix_plan(sized, seed, **limits)).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        taken(F.col("size"), F.col("key")).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, seed: str = SEED, **limits) -> DataFrame:
    """The mix itself: every repetition a row with the columns of ``docs``.

    A fractional repetition holds the first words of its text, as many as were taken.
    ``n_chars``, where there is such a column, is that of the new text.
    """
    names = docs.columns
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        source_key(F.col("source")).alias("skey"),
        order_key(F.col("doc_id"), seed).alias("key"),
        word_count(F.col("text")).alias("size"),
    )
    sized = staged(packed.select("skey", "key", "size"), "mix-sizes")
    rows = join_plan(packed, mix_plan(sized, seed, **limits)).withColumn(
        "taken", taken(F.col("size"), F.col("key")).cast("long")
    )
    words = F.expr("if(copy * size <= taken, size, taken - (copy - 1) * size)")
    # Words with the white space before them; a counted repeat in the pattern would recurse.
    parts = F.regexp_extract_all(
        F.col("row.text"), F.lit(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"), 0
    )
    prefix = F.array_join(F.slice(parts, F.lit(1), F.col("words").cast("int")), "")
    text = F.when(F.col("words") < F.col("size"), prefix).otherwise(F.col("row.text"))
    # A text without words has no size to fill; it is kept once.
    copies = F.expr(
        "if(size = 0, sequence(1L, 1L), if(taken = 0, array(), "
        "sequence(1L, taken div size + if(taken % size > 0, 1L, 0L))))"
    )
    out = (
        rows.withColumn("copy", F.explode(copies))
        .withColumn("words", words)
        .withColumn("new_text", text)
    )
    changed = {"text": F.col("new_text")}
    if "n_chars" in names:
        kind = dict(docs.dtypes)["n_chars"]
        changed["n_chars"] = F.when(
            F.col("words") < F.col("size"), F.length("new_text")
        ).otherwise(F.col("row.n_chars")).cast(kind)
    return out.select(
        *[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in names]
    )


def query(spark, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
         md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (
  SELECT skey, sum(size)::BIGINT AS source_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY skey) - 1) % 3] AS weight
  FROM d GROUP BY skey),
r AS (
  SELECT *, 2 * source_size AS cap, (2 * source_size) / weight::DOUBLE AS ratio,
         sum(source_size) OVER () * 150 / 100.0::DOUBLE AS total FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY ratio, skey) AS place FROM r),
l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING
           AND 1 PRECEDING), 0)::DOUBLE)
         / (sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE
         AS lvl FROM o),
v AS (SELECT arg_min(lvl, place) AS lvl FROM l WHERE lvl <= ratio),
t AS (
  SELECT skey, source_size,
         coalesce(least(weight * (SELECT lvl FROM v), cap::DOUBLE), cap::DOUBLE) AS target FROM o),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END
         AS whole FROM t),
q AS (SELECT *, floor(target + 0.5)::BIGINT - whole * source_size AS extra FROM p),
g AS (
  SELECT d.*, q.source_size, q.target, q.whole, q.extra,
         sum(size) OVER (PARTITION BY d.skey ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING
           AND CURRENT ROW) AS upto,
         sum(size) OVER (PARTITION BY d.skey, k) AS same
  FROM d JOIN q ON d.skey = q.skey)
SELECT doc_id, size, source_size, target,
       (whole * size + CASE WHEN upto <= extra THEN size
         WHEN upto - same < extra THEN (size * (extra - (upto - same))) // same ELSE 0 END)::BIGINT AS taken
FROM g
"""
