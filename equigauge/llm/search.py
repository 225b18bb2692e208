r"""Ranked lexical search by norm buckets.

A document is a vector of integer impacts over the terms of the items, an item a vector of its
term counts, and the score of the two is their inner product. Documents are ordered by the length
of their vector, longest first, and cut into buckets of similar length. A bucket is left out for an
item where the Cauchy-Schwarz bound, length of the item times the longest vector of the bucket, or
the sum of the largest impacts of the bucket by coordinate, does not reach the item's threshold,
the score of its k-th best document so far. Inside a bucket the item's heaviest coordinates are
added up exactly, what the others can still bring is bounded (by their largest impacts, and by
Cauchy-Schwarz over the parts of both vectors that are left), and only documents whose bound
reaches the threshold are scored, with all terms, in 64-bit integers. Bounds are rounded up, so no
document is lost to them.

Texts are read once for each block of items: a table of term counts gives the document frequencies,
from those come the impacts, which are range partitioned by length and id (so that copies of one
length are split) and written sorted. The longest 64th of the documents is searched first; the
thresholds it gives hold for all others, and a length below which no item can be reached is
pushed into the scan. Every task returns at most k documents an item.

Bounded by a parameter: items come in blocks of ``BLOCK_CHARS`` characters of distinct texts;
terms, weights and thresholds of one block are held by driver and tasks. Equal item texts are
searched once.

Defined cases: a null or empty text has no terms; documents without terms do not count; items
without a term that a document has get no rows; rows with the same doc_id are documents of their
own; a null doc_id comes last among equal scores; every row of items gets its ranks, repeated or
null item_id included; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equigauge.llm.common import prepare, read_table, small_batches, staged

TOP = 20
#: Distinct item texts of one block, in characters; a longer text is a block with few others.
BLOCK_CHARS = 4_000_000
#: Vectors of a bucket are at least this share of its longest one, and at most so many.
RATIO = 0.9
BUCKET_ROWS, BUCKET_TERMS = 4096, 1 << 21
#: Coordinates of an item that are added up before the rest is bounded.
FOCUS = 12
#: The first round searches this share of the documents.
FIRST = 1 / 64
SALTS = 32
#: What rounding of doubles may take from a bound.
UP = 1 + 1e-9

#: A-Z lower-cased; bytes that belong to no term are blanks (UTF-8 bytes above 7F belong to terms).
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if chr(b).isascii() and chr(b).isalnum() or b >= 0x80 else 0x20
    for b in range(256)
)

COUNTS = "doc_id long, n long, terms array<int>, counts array<int>"
IMPACTS = "doc_id long, length double, terms array<int>, impacts array<long>"
HITS = "item int, doc_id long, score long"


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class Items:
    """Items of a block as rows of term counts over the block's own vocabulary."""

    def __init__(self, texts: list[str | None]):
        self.vocabulary: dict[bytes, int] = {}
        self.terms: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        for text in texts:
            found = terms_of(text.encode() if text else None)
            ids = [self.vocabulary.setdefault(t, len(self.vocabulary)) for t in found]
            terms, times = np.unique(np.array(ids, np.int64), return_counts=True)
            self.terms.append(terms)
            self.times.append(times.astype(np.int64))
        self.length = np.array([math.sqrt(float((c.astype(float) ** 2).sum())) for c in self.times])


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.array([], np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Documents with a term: how many they have, and the counts of those of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            ids, lengths, terms, counts = [], [], [], []
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                found = terms_of(text)
                if not found:
                    continue
                known = [v for v in map(vocabulary.get, found) if v is not None]
                own, times = np.unique(np.array(known, np.int32), return_counts=True)
                ids.append(doc_id)
                lengths.append(len(found))
                terms.append(own)
                counts.append(times)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    _lists(terms, pa.int32()),
                    _lists(counts, pa.int32()),
                ],
                names=["doc_id", "n", "terms", "counts"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, COUNTS)


def _rows(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a list column, from the first row of this batch on."""
    offsets = column.offsets.to_numpy()
    return offsets - offsets[0], column.flatten().to_numpy()


def impact_vectors(counts: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """Impact of every term on its document, and the length of the vector."""

    def impacts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, terms = _rows(batch.column("terms"))
            _, times = _rows(batch.column("counts"))
            times = times.astype(np.int64)
            m = 75 + (25 * n_docs * batch.column("n").to_numpy()) // n_terms
            per_row = np.diff(offsets)
            value = weights[terms] * ((1_000_000_000 * times) // (1000 * times + 12 * np.repeat(m, per_row)))
            length = np.sqrt(
                np.bincount(np.repeat(np.arange(len(per_row)), per_row), value.astype(float) ** 2, len(per_row))
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(length),
                    batch.column("terms"),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(value)),
                ],
                names=["doc_id", "length", "terms", "impacts"],
            )

    return counts.filter(F.size("terms") > 0).mapInArrow(impacts, IMPACTS)


class _Best:
    """The k best documents of every item that a task has seen."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k, self.floors = k, floors.astype(np.int64)
        self.held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def take(self, item: int, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        if item in self.held:
            pairs = zip(self.held[item], (scores, ids, missing), strict=True)
            scores, ids, missing = (np.concatenate(x) for x in pairs)
        if len(scores) > self.k:
            keep = np.lexsort((ids, missing, -scores))[: self.k]
            scores, ids, missing = scores[keep], ids[keep], missing[keep]
        self.held[item] = scores, ids, missing
        if len(scores) == self.k:
            self.floors[item] = max(self.floors[item], scores.min())

    def batch(self) -> pa.RecordBatch:
        items = sorted(self.held)
        columns = [np.concatenate([self.held[i][c] for i in items]) for c in range(3)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(items, [len(self.held[i][0]) for i in items]), pa.int32()),
                pa.array(columns[1], pa.int64(), mask=columns[2]),
                pa.array(columns[0], pa.int64()),
            ],
            names=["item", "doc_id", "score"],
        )


class _Bucket:
    """Documents of similar length, by row and by coordinate."""

    def __init__(self, ids, missing, lengths, sizes, terms, impacts):
        self.ids, self.missing, self.lengths = ids, missing, lengths
        self.terms, self.impacts, self.sizes = terms, impacts, sizes
        self.starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        order = np.argsort(terms, kind="stable")
        self.docs = np.repeat(np.arange(len(sizes)), sizes)[order]
        self.values = impacts[order]
        self.coordinates, self.first = np.unique(terms[order], return_index=True)
        self.last = np.append(self.first[1:], len(terms))
        self.largest = np.maximum.reduceat(self.values, self.first)

    def search(self, item: int, terms: np.ndarray, times: np.ndarray, best: _Best, counts: np.ndarray) -> None:
        at = np.searchsorted(self.coordinates, terms)
        at[at == len(self.coordinates)] = 0
        here = self.coordinates[at] == terms
        at, weight = at[here], times[here]
        most = weight * self.largest[at]
        floor = max(int(best.floors[item]), 1)
        if most.sum() < floor:
            return
        order = np.argsort(-most, kind="stable")
        partial = np.zeros(len(self.ids))
        left = self.lengths**2
        for c in order[:FOCUS]:
            span = slice(self.first[at[c]], self.last[at[c]])
            docs, values = self.docs[span], self.values[span].astype(float)
            partial[docs] += weight[c] * values
            left[docs] -= values**2
        rest = order[FOCUS:]
        length = math.sqrt(float((weight[rest].astype(float) ** 2).sum()))
        # What is left of a length can't be told from nothing below the rounding of its square.
        left = np.sqrt(np.maximum(left, 0) + 1e-9 * self.lengths**2)
        bound = (partial + np.minimum(float(most[rest].sum()), length * left)) * UP
        near = np.flatnonzero(bound >= floor)
        if not len(near):
            return
        # All terms of what is left, exactly.
        sizes = self.sizes[near]
        ends = np.cumsum(sizes)
        spots = np.arange(ends[-1]) + np.repeat(self.starts[near] - (ends - sizes), sizes)
        counts[terms] = times
        parts = counts[self.terms[spots]] * self.impacts[spots]
        counts[terms] = 0
        scores = np.add.reduceat(parts, ends - sizes)
        hit = scores >= floor
        if hit.any():
            best.take(item, scores[hit], self.ids[near[hit]], self.missing[near[hit]])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[_Bucket]:
    """Consecutive vectors of similar length; every vector has at least one coordinate."""
    held: list[tuple] = []
    longest = rows = entries = 0

    def made() -> _Bucket:
        return _Bucket(*(np.concatenate(x) for x in zip(*held, strict=True)))

    for batch in batches:
        offsets, terms = _rows(batch.column("terms"))
        _, impacts = _rows(batch.column("impacts"))
        lengths = batch.column("length").to_numpy()
        column = batch.column("doc_id")
        missing = column.is_null().to_numpy(zero_copy_only=False)
        ids = column.fill_null(np.iinfo(np.int64).max).to_numpy()
        start = 0
        while start < len(lengths):
            if not held:
                longest = lengths[start]
            room = lengths[start : start + BUCKET_ROWS - rows]
            fits = (room <= longest) & (room >= RATIO * longest)
            fits &= offsets[start + 1 : start + 1 + len(room)] - offsets[start] <= max(BUCKET_TERMS - entries, 0)
            if not held:
                fits[0] = True
            stop = start + (len(room) if fits.all() else int(np.argmin(fits)))
            if stop > start:
                span = slice(offsets[start], offsets[stop])
                part = slice(start, stop)
                sizes = np.diff(offsets[start : stop + 1])
                held.append((ids[part], missing[part], lengths[part], sizes, terms[span], impacts[span]))
                rows, entries = rows + stop - start, entries + offsets[stop] - offsets[start]
            if stop < len(lengths):
                yield made()
                held, rows, entries = [], 0, 0
            start = stop
    if held:
        yield made()


def hits(vectors: DataFrame, items: Items, floors: np.ndarray, k: int) -> DataFrame:
    """For every item at most k documents of each task that reach its floor."""
    terms, times, lengths = items.terms, items.times, items.length
    size = len(items.vocabulary)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(floors, k)
        counts = np.zeros(size, np.int64)
        for bucket in _buckets(batches):
            reach = lengths * bucket.lengths.max() * UP
            for item in np.flatnonzero((reach >= best.floors) & (lengths > 0)):
                bucket.search(int(item), terms[item], times[item], best, counts)
        if best.held:
            yield best.batch()

    return vectors.mapInArrow(search, HITS)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of each item, first by shares of the documents, then of those."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    shares = found.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    place = F.row_number().over(Window.partitionBy("item", "_salt").orderBy(*order))
    few = shares.withColumn("_place", place).filter(F.col("_place") <= k)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    return few.select("item", rank.alias("rank"), "doc_id", "score").filter(F.col("rank") <= k)


def search_block(texts: list[str | None], docs: DataFrame, k: int = TOP) -> DataFrame | None:
    """item (place in ``texts``), rank, doc_id, score; None where no document has a term of them."""
    items = Items(texts)
    counts = staged(term_counts(docs, items.vocabulary), "search-counts")
    n_docs, n_terms = counts.agg(F.count("*"), F.sum("n")).first()
    if not n_docs or not items.vocabulary:
        return None
    # One row for each term of the block.
    held = counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    weights = np.zeros(len(items.vocabulary), np.int64)
    for term, df in held:
        weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    vectors = staged(
        impact_vectors(counts, weights, n_docs, n_terms)
        .repartitionByRange(F.col("length").desc(), "doc_id")
        .sortWithinPartitions(F.col("length").desc(), "doc_id"),
        "search-vectors",
    )
    cut = vectors.approxQuantile("length", [1 - FIRST], FIRST / 8)
    if not cut:
        return None
    nothing = np.zeros(len(texts), np.int64)
    first = staged(_merged(hits(vectors.filter(F.col("length") >= cut[0]), items, nothing, k), k), "search-first")
    floors = nothing.copy()
    for item, score in first.filter(F.col("rank") == k).select("item", "score").collect():
        floors[item] = score
    live = items.length > 0
    least = float((floors[live] / items.length[live]).min()) / UP if live.any() else 0.0
    others = vectors.filter((F.col("length") < cut[0]) & (F.col("length") >= least))
    return _merged(first.drop("rank").unionByName(hits(others, items, floors, k)), k)


def ranked(items: DataFrame, docs: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of every row of items."""
    spark = prepare(docs.sparkSession)
    keyed = items.select("item_id", F.col("text").cast("string").alias("text")).withColumn(
        "_key", F.md5(F.coalesce("text", F.lit("")))
    )
    texts = staged(keyed.select("_key", "text").dropDuplicates(["_key"]), "search-items")
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / BLOCK_CHARS))
    done = []
    for block in range(blocks):
        mine = texts.filter(F.pmod(F.xxhash64("_key"), F.lit(blocks)) == block).collect()
        found = search_block([r["text"] for r in mine], docs, k) if mine else None
        if found is not None:
            names = spark.createDataFrame([(i, r["_key"]) for i, r in enumerate(mine)], "item int, _key string")
            done.append(found.join(names, "item").select("_key", "rank", "doc_id", "score"))
    if not done:
        kinds = f"item_id {dict(items.dtypes)['item_id']}, rank int, doc_id long, score long"
        return spark.createDataFrame([], kinds)
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return keyed.drop("text").join(every, "_key").select("item_id", "rank", "doc_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return ranked(read_table(spark, sf_dir, "benchmark"), read_table(spark, sf_dir, "documents"))


_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

SQL = f"""
WITH terms AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY ALL),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS every FROM sizes),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM tfs, totals GROUP BY term, docs),
wanted AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark),
items AS (SELECT item_id, term, count(*) AS times FROM wanted GROUP BY ALL),
scores AS (
  SELECT item_id, doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // every))))::BIGINT AS score
  FROM items JOIN tfs USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), totals
  GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= {TOP}
"""
