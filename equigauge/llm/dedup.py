"""Near-duplicates by b-bit MinHash, confirmed on full shingle sets.

1. One pass over the texts gives every document its set of word shingles as 64-bit hashes, a
   128-bit digest of the set, ``HASHES`` minima, the keys of ``HASHES // ROWS`` bands of them, and
   of each minimum only its lowest four bits, packed 16 to a long. Documents with equal sets are
   one node from here on; copies never meet in pairs.
2. Nodes that share a band key are candidates. Of every bucket one node is the hub: the one that
   meets most others in all its buckets. Each member is compared with the hub only. Pairs are kept
   by estimated similarity, from the number of equal four-bit fields less chance collisions, with
   a margin of six standard deviations, and then confirmed on the full sets.
3. Confirmed links give components. Only members of one bucket that are still in different
   components are compared further, by signatures and then by full sets, in blocks of bounded
   size, each pair in the first bucket that it shares, so that no link between two texts is lost.
   Nothing is compared inside a component, which is where large groups are.

Two sets of similarity s share no band with probability (1 - s^4)^32: 5e-8 at 0.8, less above; the
margin adds about 1e-9. Everything else is exact. Intersections are counted on 64-bit hashes.

The texts of candidates are found again through a bitmap of fixed size over their ids (false hits
only cost time), so texts are never shuffled. Sets are sent to the hub they are compared with, in
slices, and streamed past it.

Defined cases: a text with fewer words than the width has its whole sequence as one shingle; a
null text, or one without words, has an empty set, is linked with nothing and is kept; rows with
the same id are one document; a row without an id takes part through its text, has no component
id unless a copy or near copy of it has one, and is kept only without one; an empty table gives an
empty result; other columns never enter the work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equigauge.llm.common import read_table, small_batches, staged
from equigauge.llm.components import components

WIDTH = 5
PERCENT = 80
HASHES, ROWS, BITS = 128, 4, 4
#: Members and leftovers of a bucket that meet in one block.
MEMBER_BLOCK, LEFT_BLOCK = 512, 256
#: Members that are streamed past one copy of their hub.
HUB_SLICE = 256
#: Bits of the bitmap over ids of candidates: 4 MB.
BITMAP = 1 << 25

_rng = np.random.default_rng(20)
_XOR = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_MUL = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)

_word_hashes: dict[bytes, int] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; A-Z are lower-cased first."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    known = _word_hashes
    if len(known) > 200_000:
        known.clear()
    for word in set(words):
        if word not in known:
            known[word] = xxhash.xxh64_intdigest(word)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    with np.errstate(over="ignore"):
        made = np.full(len(words) - n + 1, np.uint64(n))
        for i in range(n):
            made = _mixed(made * _STEP + hashes[i : len(words) - n + 1 + i])
    return np.unique(made)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of the set under each hash function."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    short = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(short), 1024):
            part = (short[i : i + 1024, None] ^ _XOR) * _MUL
            part ^= part >> np.uint32(15)
            np.minimum(low, part.min(axis=0), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low.reshape(-1, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        keys = np.arange(1, len(rows) + 1, dtype=np.uint64)
        for i in range(ROWS):
            keys = _mixed(keys * _STEP + rows[:, i])
    return keys.view(np.int64)


def packed_bits(low: np.ndarray) -> np.ndarray:
    """The lowest four bits of each minimum, 16 to a long."""
    fields = (low & np.uint32(15)).astype(np.uint64).reshape(-1, 16)
    return np.bitwise_or.reduce(fields << np.arange(0, 64, 4, dtype=np.uint64), axis=1).view(np.int64)


def least_equal_fields(percent: int = PERCENT) -> int:
    """Equal fields that a pair of this similarity has, less six standard deviations."""
    s = percent / 100
    p = s + (1 - s) / (1 << BITS)
    return int(HASHES * p - 6 * (HASHES * p * (1 - p)) ** 0.5)


def equal_fields(a: Column, b: Column) -> Column:
    """Fields in which two packed signatures agree, by bit counts."""
    ones = F.lit(0x1111111111111111)
    total = F.lit(0)
    for i in range(HASHES // 16):
        x = F.get(a, i).bitwiseXOR(F.get(b, i))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        total = total + F.bit_count(x.bitwiseAND(ones))
    return HASHES - total


def _signatures(width: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sizes, keys, bands, bits = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingle_set(text, width)
                sizes.append(len(found))
                low = minima(found) if len(found) else None
                keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                bands.append(None if low is None else band_keys(low))
                bits.append(None if low is None else packed_bits(low))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(bits, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "node", "bands", "bits"],
            )
        _word_hashes.clear()

    return sign


def _bit_of(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(BITMAP))


def _full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node and set of the documents whose ids are in ``wanted`` (doc_id), and of a few others."""
    bit = _bit_of(F.col("doc_id"))
    longs = (
        wanted.select(bit.alias("place"))
        .select(
            F.expr("CAST(place DIV 64 AS INT)").alias("at"),
            F.expr("shiftleft(1L, CAST(place % 64 AS INT))").alias("bit"),
        )
        .groupBy("at")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()
    )
    bitmap = np.zeros(BITMAP // 64, np.int64)
    bitmap[longs["at"].to_numpy()] = longs["bits"].to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(bitmap.tobytes())

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sent.value, np.uint64)
        for batch in small_batches(batches):
            at = batch.column("bit").to_numpy(zero_copy_only=False)
            hit = np.flatnonzero(bits[at // 64] >> (at % 64).astype(np.uint64) & np.uint64(1))
            texts = batch.column("text").take(pa.array(hit)).to_pylist()
            found = [shingle_set(t, width) for t in texts]
            found = [x for x in found if len(x)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in found], pa.binary()),
                    pa.array([x.tobytes() for x in found], pa.binary()),
                ],
                names=["node", "shingles"],
            )
        _word_hashes.clear()

    rows = docs.select("text", F.coalesce(bit, F.lit(0)).alias("bit"))
    return rows.mapInArrow(sets, "node binary, shingles binary").dropDuplicates(["node"])


def _confirmed(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.empty(0, np.uint64)
        for batch in small_batches(batches):
            a, b = [], []
            columns = [batch.column(c).to_pylist() for c in ("hub", "node", "shingles")]
            for to, node, raw in zip(*columns, strict=True):
                other = np.frombuffer(raw, np.uint64)
                if to == node:
                    hub, own = node, other
                    continue
                if to != hub:
                    raise ValueError("a set came before its hub")
                if 100 * min(len(own), len(other)) < percent * max(len(own), len(other)):
                    continue
                both = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(other) - both):
                    a.append(node)
                    b.append(hub)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"]
            )

    return confirm


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (node, hub) whose full sets are similar enough, as links (a, b).

    Each set travels to the hubs it is compared with; a hub with many members is copied to one
    slice of them after another.
    """
    slices = pairs.groupBy("hub").agg(
        F.ceil(F.count("*") / HUB_SLICE).cast("int").alias("slices")
    )
    members = (
        pairs.join(slices, "hub")
        .withColumn("slice", F.pmod(F.xxhash64("node", "hub"), F.col("slices")).cast("int"))
        .select("hub", "node", "slice")
    )
    hubs = slices.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    sent = members.unionByName(hubs.select("hub", F.col("hub").alias("node"), "slice"))
    return (
        sent.join(sets, "node")
        .repartition("hub", "slice")
        .sortWithinPartitions("hub", "slice", F.col("hub") != F.col("node"))
        .select("hub", "node", "shingles")
        .mapInArrow(_confirmed(percent), "a binary, b binary")
    )


_ZERO_FIELDS = np.array([(x & 15 == 0) + (x >> 4 == 0) for x in range(256)], np.uint8)


def _met(rows: list[dict], least: int) -> Iterator[tuple[dict, np.ndarray, list[dict]]]:
    """Each leftover of a block, the members that it is to be compared with, and all members.

    These are of other components, similar enough by their signatures, and meet here first: the
    block's bucket is of the first band that the two share. Two leftovers meet in one order only.
    """
    left = [r for r in rows if r["side"] == 0]
    members = [r for r in rows if r["side"] == 1]
    if not left or not members:
        return
    bits = np.array([r["bits"] for r in members], np.int64).view(np.uint8)
    bands = np.array([r["bands"] for r in members], np.int64)
    owners = np.array([r["owner"] for r in members], object)
    names = np.array([r["node"] for r in members], object)
    early = np.array([not r["late"] for r in members])
    for r in left:
        own_bits, own_bands = np.array(r["bits"], np.int64).view(np.uint8), np.array(r["bands"], np.int64)
        equal = _ZERO_FIELDS[bits ^ own_bits].sum(axis=1, dtype=np.int32)
        at = np.flatnonzero((equal >= least) & (owners != r["owner"]) & (early | (names > r["node"])))
        first = (bands[at] == own_bands).argmax(axis=1)
        at = at[own_bands[first] == r["bucket"]]
        if len(at):
            yield r, at[np.argsort(-equal[at], kind="stable")], members


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    group, rows = None, []
    for batch in small_batches(batches, 256):
        for row in batch.to_pylist():
            key = (row["bucket"], row["left_block"], row["member_block"])
            if key != group:
                if rows:
                    yield rows
                group, rows = key, []
            rows.append(row)
    if rows:
        yield rows


def _marked(least: int):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """bucket and node of those that have anything to be compared with."""
        for rows in _blocks(batches):
            nodes = set()
            for r, at, members in _met(rows, least):
                nodes.add(r["node"])
                nodes.update(members[i]["node"] for i in at.tolist())
            yield pa.RecordBatch.from_arrays(
                [pa.array([rows[0]["bucket"]] * len(nodes), pa.int64()), pa.array(sorted(nodes), pa.binary())],
                names=["bucket", "node"],
            )

    return mark


def _linked(least: int, percent: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links that join components: a link between two that are joined already isn't sought."""
        for rows in _blocks(batches):
            root: dict[bytes, bytes] = {}

            def top(x: bytes, root=root) -> bytes:
                while x in root:
                    x = root[x]
                return x

            found = []
            for r, at, members in _met(rows, least):
                own = np.frombuffer(r["shingles"], np.uint64)
                for m in map(members.__getitem__, at.tolist()):
                    mine, others = top(r["owner"]), top(m["owner"])
                    if mine == others:
                        continue
                    other = np.frombuffer(m["shingles"], np.uint64)
                    if 100 * min(len(own), len(other)) < percent * max(len(own), len(other)):
                        continue
                    near = np.minimum(np.searchsorted(own, other), len(own) - 1)
                    both = int((own[near] == other).sum())
                    if 100 * both >= percent * (len(own) + len(other) - both):
                        found.append((r["node"], m["node"]))
                        root[mine] = others
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary())],
                names=["a", "b"],
            )

    return link


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Every leftover with every member of its bucket, in blocks of bounded size."""
    draw = F.xxhash64("node")
    member = rows.withColumn("side", F.lit(1)).withColumn(
        "member_block", F.pmod(draw, F.col("member_blocks")).cast("int")
    ).withColumn("left_block", F.explode(F.sequence(F.lit(0), F.col("left_blocks") - 1)))
    left = rows.filter("late").withColumn("side", F.lit(0)).withColumn(
        "left_block", F.pmod(draw, F.col("left_blocks")).cast("int")
    ).withColumn("member_block", F.explode(F.sequence(F.lit(0), F.col("member_blocks") - 1)))
    names = ["bucket", "left_block", "member_block", "node", "owner", "late", "side"]
    return left.select(*names).union(member.select(*names))


def _dealt(rows: DataFrame) -> DataFrame:
    keys = ["bucket", "left_block", "member_block"]
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def open_links(
    members: DataFrame, nodes: DataFrame, labels: DataFrame, sets: DataFrame, percent: int
) -> DataFrame:
    """Links between nodes that share a bucket and are in different components still.

    Of each bucket the component with most members is set against itself by nothing; all others,
    the leftovers, meet every member that is not of their own component. First by signatures, to
    mark those that have to meet by their full sets; only these are sent.
    """
    owned = staged(
        members.join(labels, "node", "left").select(
            "bucket", "node", F.coalesce("label", "node").alias("owner")
        ),
        "owned",
    )

    def open_buckets(rows: DataFrame) -> DataFrame:
        sizes = rows.groupBy("bucket", "owner").agg(F.count("*").alias("n")).groupBy("bucket").agg(
            F.count("*").alias("owners"),
            F.sum("n").alias("size"),
            F.max(F.struct("n", "owner")).alias("largest"),
        )
        largest = sizes.filter("owners > 1").select(
            "bucket",
            F.col("largest.owner").alias("main"),
            F.ceil(F.col("size") / MEMBER_BLOCK).cast("int").alias("member_blocks"),
            F.ceil((F.col("size") - F.col("largest.n")) / LEFT_BLOCK).cast("int").alias("left_blocks"),
        )
        joined = rows.join(staged(largest, "open-buckets"), "bucket")
        return joined.withColumn("late", F.col("owner") != F.col("main"))

    least = least_equal_fields(percent)
    signs = nodes.select("node", "bits", "bands")
    marked = staged(
        _dealt(_in_blocks(open_buckets(owned)).join(signs, "node")).mapInArrow(
            _marked(least), "bucket long, node binary"
        ),
        "marked",
    ).distinct()
    near = staged(owned.join(marked, ["bucket", "node"]), "near")
    rows = _in_blocks(open_buckets(near)).join(signs, "node").join(sets, "node")
    return _dealt(rows).mapInArrow(_linked(least, percent), "a binary, b binary")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    component_id is the smallest doc_id that can be reached through links of at least ``percent``
    hundredths of similarity; kept says whether it is the document's own.
    """
    kind = dict(docs.dtypes)["doc_id"]
    texts = docs.select("doc_id", "text")
    signed = staged(
        texts.mapInArrow(
            _signatures(width),
            f"doc_id {kind}, n_shingles long, node binary, bands array<long>, bits array<long>",
        ),
        "signatures",
    )
    nodes = staged(
        signed.filter("node IS NOT NULL")
        .groupBy("node")
        .agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("bits").alias("bits")),
        "nodes",
    )
    entries = nodes.select(F.explode("bands").alias("bucket"), "node")
    shared = entries.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    members = staged(entries.join(shared, "bucket"), "members")
    reach = members.groupBy("node").agg(F.sum("size").alias("reach"))
    hubs = staged(
        members.join(staged(reach, "reach"), "node")
        .groupBy("bucket")
        .agg(F.max(F.struct("reach", "node")).alias("hub"))
        .select("bucket", "hub.node"),
        "hubs",
    ).withColumnRenamed("node", "hub")
    least = least_equal_fields(percent)
    bits = nodes.select("node", "bits")
    first = (
        members.join(hubs, "bucket").filter("node <> hub").select("node", "hub").distinct()
        .join(bits, "node")
        .join(bits.select(F.col("node").alias("hub"), F.col("bits").alias("hub_bits")), "hub")
        .filter(equal_fields(F.col("bits"), F.col("hub_bits")) >= least)
        .select("node", "hub")
    )
    candidates = nodes.join(members.select("node").distinct(), "node", "left_semi")
    sets = staged(_full_sets(texts, candidates.select("doc_id"), width), "sets")
    links = staged(confirm(first, sets, percent), "links")
    more = staged(open_links(members, nodes, components(links), sets, percent), "links")
    labels = components(links.unionByName(more))
    named = nodes.select("node", "doc_id").join(labels, "node", "left").select(
        "node", "doc_id", F.coalesce("label", "node").alias("label")
    )
    named = staged(named, "named")
    least_ids = staged(named.groupBy("label").agg(F.min("doc_id").alias("component_id")), "least-ids")
    of_node = staged(named.join(least_ids, "label").select("node", "component_id"), "node-components")
    component = F.coalesce("component_id", "doc_id")
    return signed.select("doc_id", "n_shingles", "node").join(of_node, "node", "left").select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), width=4)
