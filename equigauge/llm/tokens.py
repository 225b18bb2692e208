"""Token ids as binary files: fixed-size blocks of ids, split into planes.

A block of up to ``BLOCK`` ids is turned so that the first bytes (or bits) of all ids stand
together, then the second, and so on; each such plane is compressed with zstandard by itself. The
high planes are nearly constant and all but vanish.

Blocks are rows of a Parquet table, written and read by Spark, so that the files may lie in any
store and a lost executor only repeats its task. A row holds shard and number of the block, the
count of its ids, the ids of its shard before it, its payload (format below), and the documents
that it holds a piece of: the chunk index. Shards are ranges of doc_id of about
``DOCS_PER_SHARD`` documents (at most ``MAX_SHARDS`` shards, then larger); inside a shard documents
are in ascending order, so the blocks in order of shard and number are the ids of the corpus in
ascending order of doc_id. A task holds one block at a time.

Payload: ``EQP1``, mode (0 byte planes, 1 bit planes), bytes per id, two zero bytes, number of ids
and length of each plane as little-endian unsigned 32-bit integers, then the planes.

Defined cases: a null text is empty and has only the end id; a null doc_id comes first; rows with
the same doc_id are ordered by their ids; an empty table writes no block; other columns are
ignored.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equigauge.llm import vocab
from equigauge.llm.common import read_table, small_batches, staged

BLOCK = 65_536
DOCS_PER_SHARD = 8_192
MAX_SHARDS = 10_000
END_ID = 2
MAGIC = b"EQP1"
BLOCK_SCHEMA = (
    "shard int, block int, n_ids int, before long, payload binary, "
    "docs array<struct<doc_id: long, place: long, begin: int, count: int>>"
)
PIECE_SCHEMA = (
    "shard int, place long, doc_id long, block int, begin long, count long, crc long, ids binary"
)


def pack_block(ids: np.ndarray, bits: bool = False, level: int = 3) -> bytes:
    """The payload of a block of unsigned integers."""
    width = ids.dtype.itemsize
    rows = np.ascontiguousarray(ids.astype(f"<u{width}", copy=False)).view(np.uint8).reshape(-1, width)
    planes = np.unpackbits(rows, axis=1, bitorder="little").T if bits else rows.T
    squeeze = zstandard.ZstdCompressor(level=level)
    packed = [
        squeeze.compress(np.packbits(p, bitorder="little").tobytes() if bits else p.tobytes())
        for p in planes
    ]
    head = struct.pack("<4sBBH", MAGIC, int(bits), width, 0)
    return head + struct.pack(f"<{1 + len(packed)}I", len(ids), *map(len, packed)) + b"".join(packed)


def unpack_block(payload: bytes) -> np.ndarray:
    magic, bits, width, _ = struct.unpack_from("<4sBBH", payload)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    n_planes = width * (8 if bits else 1)
    n, *lengths = struct.unpack_from(f"<{1 + n_planes}I", payload, 8)
    at, spread = 8 + 4 * (1 + n_planes), zstandard.ZstdDecompressor()
    planes = []
    for length in lengths:
        raw = np.frombuffer(spread.decompress(payload[at : at + length]), np.uint8)
        planes.append(np.unpackbits(raw, count=n, bitorder="little") if bits else raw)
        at += length
    if not n:
        return np.empty(0, f"<u{width}")
    rows = np.stack(planes, axis=1)
    if bits:
        rows = np.packbits(rows, axis=1, bitorder="little")
    return np.ascontiguousarray(rows).view(f"<u{width}").ravel()


def shard_bounds(docs: DataFrame, docs_per_shard: int = DOCS_PER_SHARD) -> list[int]:
    """Upper bounds of all shards but the last."""
    n = docs.count()
    shards = min(MAX_SHARDS, max(1, -(-n // docs_per_shard)))
    if shards == 1:
        return []
    cuts = [i / shards for i in range(1, shards)]
    found = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), cuts, 20 * shards)).first()[0]
    return sorted(set(found or []))


def encode_shards(docs: DataFrame, source: str, bounds: list[int], end_id: int | None) -> DataFrame:
    """shard, doc_id and packed ids of every document."""
    kind = vocab.id_type(source)
    end = b"" if end_id is None else array(kind, [end_id]).tobytes()
    cuts = np.array(bounds, dtype=np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = vocab.lower_case_coder(source, kind).many
        for batch in small_batches(batches):
            numbers = batch.column("doc_id")
            known = numbers.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            ids = [x + end for x in code([t or "" for t in batch.column("text").to_pylist()])]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.searchsorted(cuts, known, side="left").astype(np.int32)),
                    numbers,
                    pa.array(ids, pa.binary()),
                ],
                names=["shard", "doc_id", "ids"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        encode, "shard int, doc_id long, ids binary"
    )


def _block_writer(kind: str, block: int, bits: bool):
    width = array(kind).itemsize

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, place, before = None, 0, 0, 0
        held, n_held, docs = [], 0, []

        def packed() -> pa.RecordBatch:
            nonlocal number, before, n_held
            ids = np.frombuffer(b"".join(held), f"<u{width}")
            row = {
                "shard": shard, "block": number, "n_ids": n_held, "before": before,
                "payload": pack_block(ids, bits), "docs": list(docs),
            }
            number, before, n_held = number + 1, before + n_held, 0
            held.clear()
            docs.clear()
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK_ARROW)

        for batch in small_batches(batches):
            columns = [batch.column(c).to_pylist() for c in ("shard", "doc_id", "ids")]
            for own, doc_id, ids in zip(*columns, strict=True):
                if own != shard:
                    if docs:
                        yield packed()
                    shard, number, place, before = own, 0, 0, 0
                at, n = 0, len(ids) // width
                while True:
                    take = min(n - at, block - n_held)
                    docs.append({"doc_id": doc_id, "place": place, "begin": n_held, "count": take})
                    held.append(ids[at * width : (at + take) * width])
                    n_held, at = n_held + take, at + take
                    if n_held == block:
                        yield packed()
                    if at == n:
                        break
                place += 1
        if docs:
            yield packed()

    return write


_BLOCK_ARROW = pa.schema(
    [
        ("shard", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int32()), ("before", pa.int64()),
        ("payload", pa.binary()),
        ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("place", pa.int64()), ("begin", pa.int32()), ("count", pa.int32())]))),
    ]
)


def blocks(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int | None = END_ID,
    block: int = BLOCK,
    bits: bool = False,
    docs_per_shard: int = DOCS_PER_SHARD,
) -> DataFrame:
    """The blocks of all documents; write them as Parquet to have the files."""
    source = vocab.tokenizer_json(tokenizer_path)
    bounds = shard_bounds(docs, docs_per_shard)
    return (
        encode_shards(docs, source, bounds, end_id)
        .repartitionById(len(bounds) + 1, "shard")
        .sortWithinPartitions("shard", "doc_id", "ids")
        .mapInArrow(_block_writer(vocab.id_type(source), block, bits), BLOCK_SCHEMA)
    )


def _read_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, 16):
        out = []
        for row in batch.to_pylist():
            ids = unpack_block(row["payload"]).astype("<u4")
            last = len(row["docs"]) - 1
            for i, doc in enumerate(row["docs"]):
                begin, n = doc["begin"], doc["count"]
                raw = ids[begin : begin + n].tobytes()
                # A piece at either end of a block may go on in the next one.
                edge = i == last or (i == 0 and row["block"] > 0)
                out.append(
                    {
                        "shard": row["shard"], "place": doc["place"], "doc_id": doc["doc_id"],
                        "block": row["block"], "begin": row["start"] + begin, "count": n,
                        "crc": zlib.crc32(raw), "ids": raw if edge else None,
                    }
                )
        yield pa.RecordBatch.from_pylist(out, schema=_PIECE_ARROW)


_PIECE_ARROW = pa.schema(
    [
        ("shard", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()), ("block", pa.int32()),
        ("begin", pa.int64()), ("count", pa.int64()), ("crc", pa.int64()), ("ids", pa.binary()),
    ]
)


def shard_starts(written: DataFrame) -> DataFrame:
    """shard and the number of ids in all shards before it; at most ``MAX_SHARDS`` rows."""
    before = Window.partitionBy().orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return written.groupBy("shard").agg(F.sum("n_ids").alias("n")).select(
        "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )


def read_documents(written: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the blocks alone."""
    placed = written.join(F.broadcast(shard_starts(written)), "shard").select(
        "shard", "block", (F.col("base") + F.col("before")).alias("start"), "payload", "docs"
    )
    parts = F.array_sort(F.collect_list(F.struct("block", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda done, x: F.concat(done, x["ids"]))
    return (
        placed.mapInArrow(_read_pieces, PIECE_SCHEMA)
        .groupBy("shard", "place")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.min("begin").alias("start"),
            F.sum("count").alias("n_tokens"),
            F.when(F.count("*") == 1, F.max("crc")).otherwise(F.crc32(joined)).alias("ids_crc32"),
        )
        .select("doc_id", "start", "n_tokens", "ids_crc32")
    )


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    made = blocks(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return read_documents(staged(made, "token-blocks"))
