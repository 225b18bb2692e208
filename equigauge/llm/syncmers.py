"""Document fingerprints from closed syncmers.

Built-in functions only. Words are hashed; of every run of ``K`` words (a k-mer) the hash of the
smallest word (the inner substring) decides: the k-mer is an anchor if the smallest stands at its
first or last place. That depends on nothing outside the k-mer, so an edit moves no anchor that it
doesn't touch. The fingerprint is the hashes of all distinct anchors in hexadecimal, ascending, and the
likeness of two texts is the share of all their anchors that is in both. Places of anchors
(``anchors``) are no part of either.

Inside words of more than ``LONG_WORD`` characters there are anchors of characters as well: runs of
``K`` overlapping pairs of characters. Texts of at most ``SHORT`` characters have such anchors
throughout, their words joined by one space, and two such texts are compared by these alone; any
other two texts by the anchors of words and inside long words.

A text with words but no anchor of a kind has one, the hash of all its words. Equal texts have equal
fingerprints; two texts without words are alike (1), one without and one with words are not (0).

Edited texts need the next document in order of doc_id. Documents are dealt to ranges of doc_id of
about ``DOCS_PER_RANGE``, with the first document of the next range added at the end of each, and a
window inside the range finds the next one; no task sees all documents.

Defined cases: a null text is empty; a null doc_id comes first; rows with one doc_id are ordered by
text; the document after the last is the first, also for a single document, which is its own next;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equigauge.llm.common import BLANK, read_table

K = 4
SHORT, LONG_WORD = 256, 32
DOCS_PER_RANGE = 4_096
MAX_RANGES = 8_192


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(text, BLANK, -1), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def syncmer_places(hashes: Column) -> Column:
    """Places, from 1, at which an anchor starts."""

    def closed(i: Column) -> Column:
        inner = F.least(*[F.get(hashes, i + j) for j in range(K - 2)])
        return F.least(F.get(hashes, i - 1), F.get(hashes, i + K - 2)) <= inner

    starts = F.sequence(F.lit(1), F.greatest(F.size(hashes) - (K - 1), F.lit(1)))
    return F.when(F.size(hashes) < K, F.array().cast("array<int>")).otherwise(F.filter(starts, closed))


def anchor_hashes(hashes: Column, places: Column) -> Column:
    def of(i: Column) -> Column:
        return F.xxhash64(*[F.get(hashes, i + j - 1) for j in range(K)])

    return F.transform(places, of)


def anchors(docs: DataFrame) -> DataFrame:
    """doc_id, place (word, from 1) and anchor of every anchor, for matching by position."""
    hashed = docs.select("doc_id", word_hashes(F.coalesce("text", F.lit(""))).alias("h"))
    placed = hashed.withColumn("p", syncmer_places(F.col("h")))
    found = placed.select(
        "doc_id", F.arrays_zip(F.col("p").alias("place"), anchor_hashes(F.col("h"), F.col("p")).alias("anchor")).alias("a")
    )
    return found.select("doc_id", F.explode("a").alias("a")).select("doc_id", "a.place", "a.anchor")


def character_anchors(text: Column) -> Column:
    """Anchors of the characters of a text: closed syncmers over its overlapping pairs."""
    # A lambda variable of an array of one holds the pairs, so that they are made once.
    def of_pairs(pairs: Column) -> Column:
        return anchor_hashes(pairs, syncmer_places(pairs))

    def of_letters(letters: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(letters)), lambda i: i < F.size(letters) - 1)
        pairs = F.transform(places, lambda i: F.xxhash64(F.get(letters, i), F.get(letters, i + 1)))
        return F.flatten(F.transform(F.array(pairs), of_pairs))

    letters = F.filter(F.split(text, "", -1), lambda c: c != "")
    return F.flatten(F.transform(F.array(letters), of_letters))


def with_sketch(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` and the sketch of ``text``: distinct anchor hashes, ascending, of words (with those
    inside long words) and, if the text is short, of characters."""
    step = rows.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    step = step.withColumn("_w", F.filter(F.split("_t", BLANK, -1), lambda w: w != ""))
    step = step.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    step = step.withColumn("_p", syncmer_places(F.col("_h")))
    long_words = F.filter("_w", lambda w: F.length(w) > LONG_WORD)
    step = step.withColumn(
        "_a",
        F.concat(
            F.when(F.size("_p") > 0, anchor_hashes(F.col("_h"), F.col("_p"))).otherwise(F.array().cast("array<long>")),
            F.flatten(F.transform(long_words, character_anchors)),
        ),
    )
    short = F.length("_t") <= SHORT
    step = step.withColumn(
        "_c", F.when(short, character_anchors(F.array_join("_w", " "))).otherwise(F.array().cast("array<long>"))
    )
    whole = F.when(F.size("_h") > 0, F.array(F.xxhash64(F.col("_h")))).otherwise(F.array().cast("array<long>"))

    def distinct(found: str) -> Column:
        return F.sort_array(F.array_distinct(F.when(F.size(found) > 0, F.col(found)).otherwise(whole)))

    sketch = F.struct(
        short.alias("short"),
        distinct("_a").alias("words"),
        F.when(short, distinct("_c")).otherwise(F.col("_c")).alias("letters"),
    )
    return step.withColumn(name, sketch).drop("_t", "_w", "_h", "_p", "_a", "_c")


def fingerprint(sketch: Column) -> Column:
    """Anchors that a text is told by: of characters if it is short, else of words."""
    told = F.when(sketch["short"], sketch["letters"]).otherwise(sketch["words"])
    return F.array_join(F.transform(told, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    def shares(x: Column, y: Column) -> Column:
        shared = F.size(F.array_intersect(x, y))
        together = F.size(x) + F.size(y) - shared
        return F.when(together == 0, F.lit(1.0)).otherwise(shared / together)

    return F.when(a["short"] & b["short"], shares(a["letters"], b["letters"])).otherwise(shares(a["words"], b["words"]))


def range_number(doc_id: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are below doc_id, by halving; 0 for null."""
    if not bounds:
        return F.lit(0)
    listed = F.lit(bounds)

    def halve(state: Column, _: Column) -> Column:
        low, high = state["low"], state["high"]
        middle = F.shiftright(low + high, 1)
        below = F.get(listed, middle) < doc_id
        return F.when(low >= high, state).otherwise(
            F.struct(
                F.when(below, middle + 1).otherwise(low).alias("low"),
                F.when(below, high).otherwise(middle).alias("high"),
            )
        )

    start = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1))
    found = F.aggregate(steps, start, halve, lambda s: s["low"])
    return F.when(doc_id.isNull(), 0).otherwise(found)


def with_next(docs: DataFrame, per_range: int = DOCS_PER_RANGE) -> DataFrame:
    """doc_id, text, sketch, and next_text, next_sketch of the document after it."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    ranges = min(MAX_RANGES, max(1, -(-ids.count() // per_range)))
    bounds: list[int] = []
    if ranges > 1:
        cuts = [i / ranges for i in range(1, ranges)]
        bounds = sorted(set(ids.agg(F.percentile_approx("doc_id", cuts, 20 * ranges)).first()[0] or []))
    numbered = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("range", range_number(F.col("doc_id"), bounds))
    # Where each range starts: at most MAX_RANGES rows, so its window and its broadcast are small.
    order = Window.partitionBy().orderBy("range")
    firsts = (
        numbered.groupBy("range")
        .agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("first"))
        .select(
            F.coalesce(
                F.lag("range").over(order),
                F.max("range").over(Window.partitionBy()),
            ).alias("before"),
            F.col("first.doc_id").alias("first_id"),
        )
    )
    borders = (
        numbered.join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("first_id")))
        .groupBy("before")
        .agg(F.min(F.struct("text", "doc_id")).alias("row"))
        .select("row.doc_id", "row.text", F.col("before").alias("range"), F.lit(1).alias("border"))
    )
    rows = with_sketch(numbered.withColumn("border", F.lit(0)).unionByName(borders), "text", "sketch")
    line = Window.partitionBy("range").orderBy("border", F.col("doc_id").asc_nulls_first(), "text")
    return (
        rows.withColumn("next_text", F.lead("text").over(line))
        .withColumn("next_sketch", F.lead("sketch").over(line))
        .filter("border = 0")
        .select("doc_id", "text", "sketch", "next_text", "next_sketch")
    )


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Every document against its edited text and the next document."""
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), (n - cut).cast("int")), F.substring("next_text", F.lit(1), cut)
    )
    rows = with_next(docs).select(
        "doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited")
    )
    both = with_sketch(rows, "edited", "edited_sketch")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return edited_pairs(read_table(spark, sf_dir, "documents"))
