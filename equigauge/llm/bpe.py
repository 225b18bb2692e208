"""BPE encoding and decoding through a table of distinct words.

A byte-level BPE tokenizer encodes word by word, so every distinct word is encoded once and its
ids are joined back by position:

1. The most frequent words of a bounded sample of documents are encoded once and sent to all
   tasks, at most ``HOT_WORDS`` of them, none longer than ``HOT_CHARS``. The sample only decides
   which words go that way, never a result. It also takes every hot key out of the join below.
2. A pass over all texts finds the other words with their positions; each of those is encoded
   once, in a table of distinct words, and joined back to its positions.
3. A second pass writes the numbers of the frequent words, compressed by byte planes, and 0 for
   the others; the joined ids are put into those gaps by position.

Decoding joins ids with the id-to-piece table. That table is as large as the vocabulary, a fixed
size, so the join is done inside the tasks; bytes that are no UTF-8 become replacement characters.

Positions are keyed by a 128-bit digest of the text, so copies of a text share them, and each task
reports the words of a text it has seen before only once.

Tasks work on arrays of the words of many texts (see ``vocab``), each different word being looked
up once; what a task holds is bounded by ``vocab.CHUNK`` characters, or the longest text.

Defined cases: a null text is empty and has no ids; repeated rows give a row each; special tokens
in a text get their own ids; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equigauge.llm import vocab
from equigauge.llm.common import read_table, small_batches, staged

SAMPLE_DOCS = 32_768
HOT_WORDS = 327_680
HOT_CHARS = 32
#: Words that a task counts, or texts that it remembers, before it starts anew.
TASK_MEMORY = 200_000
#: Words whose ids a task puts together at a time; a longer text by itself.
FILLED_WORDS = 250_000


def _key(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode())


def word_counts(docs: DataFrame, source: str) -> DataFrame:
    """word and n, in partial counts of the tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counts = vocab.spaced_words(source), Counter()

        def flush():
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                names=["word", "n"],
            )
            counts.clear()
            return out

        for batch in small_batches(batches):
            for _, _, words in split([t or "" for t in batch.column("text").to_pylist()]):
                times = np.bincount(words.index, minlength=len(words.different))
                counts.update(dict(zip(words.different, times.tolist(), strict=True)))
                if len(counts) > TASK_MEMORY:
                    yield flush()
        if counts:
            yield flush()

    return docs.select("text").mapInArrow(count, "word string, n long")


def encode_words(words: DataFrame, source: str) -> DataFrame:
    """word and its packed ids; each row of ``words`` is encoded once."""
    kind = vocab.id_type(source)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("word").to_pylist()
            ids = vocab.word_codes(source, texts, kind)
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), pa.array(ids, pa.binary())], names=["word", "ids"]
            )

    return words.select("word").mapInArrow(encode, "word string, ids binary")


def hot_table(docs: DataFrame, source: str, sample_docs: int, hot_words: int) -> DataFrame:
    """The most frequent words of a sample and their ids, at most ``hot_words`` rows."""
    n = docs.count()
    sample = docs if n <= sample_docs else docs.sample(sample_docs / n, seed=11)
    counted = (
        word_counts(sample, source)
        .filter(F.length("word") <= HOT_CHARS)
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "word")
        .limit(hot_words)
    )
    return encode_words(counted, source)


def _numbers_of(words: list[str], known: dict[str, int]) -> np.ndarray:
    """The numbers of words, 0 for all that are not frequent."""
    return np.fromiter((known.get(w, 0) for w in words), np.uint32, len(words))


def _packed_fills(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """tkey and the codes of its other words in order of position, packed: count, lengths, codes."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    key, place, codes, out = None, None, [], []

    def batch_of():
        columns = [pa.array(x, pa.binary()) for x in zip(*out, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names=["tkey", "fills"])

    def packed():
        sizes = np.array([len(codes), *map(len, codes)], "<u4")
        return key, squeeze(sizes.tobytes() + b"".join(codes))

    for batch in small_batches(batches, 4096):
        columns = [batch.column(c).to_pylist() for c in ("tkey", "place", "ids")]
        for own, at, code in zip(*columns, strict=True):
            if own != key:
                if codes:
                    out.append(packed())
                key, place, codes = own, None, []
                if len(out) >= 1024:
                    yield batch_of()
            # Copies of a text may each have reported its words; the codes are the same.
            if at != place:
                place = at
                codes.append(code)
    if codes:
        out.append(packed())
    if out:
        yield batch_of()


def _unpacked_fills(packed: list[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of packed codes of several texts: how many each has, their sizes in ids, and the ids of all."""
    spread = zstandard.ZstdDecompressor()
    counts, sizes, ids = [], [np.empty(0, "<u4")], []
    for raw in (spread.decompress(x) if x is not None else bytes(4) for x in packed):
        n = int(np.frombuffer(raw, "<u4", 1)[0])
        counts.append(n)
        sizes.append(np.frombuffer(raw, "<u4", n, 4))
        ids.append(raw[4 * (n + 1) :])
    return (
        np.array(counts, np.int64),
        np.concatenate(sizes).astype(np.int64) // width,
        np.frombuffer(b"".join(ids), f"<u{width}"),
    )


def _filled(batches: Iterator[pa.RecordBatch], hot: vocab.Codes, kind: str) -> Iterator[pa.RecordBatch]:
    """doc_id, n_tokens, ids of rows with numbers of words and the codes of the words without."""
    spread, width = zstandard.ZstdDecompressor(), array(kind).itemsize
    for batch in small_batches(batches):
        packed, fills = batch.column("numbers").to_pylist(), batch.column("fills").to_pylist()
        lengths = [zstandard.frame_content_size(x) // 3 for x in packed]
        for start, end in vocab.ranges(lengths, FILLED_WORDS):
            planes = [np.frombuffer(spread.decompress(x), np.uint8).reshape(3, -1) for x in packed[start:end]]
            planes = np.concatenate(planes, axis=1).astype(np.int32)
            words = planes[0] | planes[1] << 8 | planes[2] << 16
            word_ends = np.cumsum([0, *lengths[start:end]])
            gaps = np.flatnonzero(words == 0)
            counts, fill_sizes, fill_ids = _unpacked_fills(fills[start:end], width)
            if (np.diff(np.searchsorted(gaps, word_ends)) != counts).any():
                raise ValueError("the words of a text do not fill its gaps")
            sizes, begins = hot.sizes[words], hot.begins[words]
            sizes[gaps], begins[gaps] = fill_sizes, len(hot.ids) + np.cumsum(fill_sizes) - fill_sizes
            ids, ends = vocab.gathered(np.concatenate([hot.ids, fill_ids]), begins, sizes)
            cuts = ends[word_ends]
            raw = pa.py_buffer(np.ascontiguousarray(ids, "<u4"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(start, end - start),
                    pa.array(np.diff(cuts)),
                    pa.Array.from_buffers(
                        pa.binary(), end - start, [None, pa.py_buffer((4 * cuts).astype(np.int32)), raw]
                    ),
                ],
                names=["doc_id", "n_tokens", "ids"],
            )


def _decoded(batches: Iterator[pa.RecordBatch], table: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Rows with ids, and the text that their pieces make."""
    piece = table.__getitem__
    for batch in small_batches(batches):
        texts = [
            b"".join(map(piece, np.frombuffer(x or b"", "<u4").tolist())).decode("utf-8", "replace")
            for x in batch.column("ids").to_pylist()
        ]
        yield batch.append_column("decoded", pa.array(texts, pa.string()))


def _joined_words(
    docs: DataFrame, source: str, sample_docs: int, hot_words: int
) -> tuple[DataFrame, Broadcast]:
    """(doc_id, numbers, fills) of every document, and the codes that the numbers name."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    code = vocab.id_type(source)
    top = hot_table(docs, source, sample_docs, min(hot_words, (1 << 24) - 1)).toArrow()
    send = docs.sparkSession.sparkContext.broadcast
    # A word's number is its place by frequency, from 1.
    hot = send({w: i for i, w in enumerate(top["word"].to_pylist(), 1)})
    hot_codes = send(vocab.Codes([b"", *top["ids"].to_pylist()], code))

    def find_rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = vocab.spaced_words(source), set()
        for batch in small_batches(batches):
            texts, keys = [], []
            for text in batch.column("text").to_pylist():
                key = _key(text)
                if key in seen:
                    continue
                if len(seen) >= TASK_MEMORY:
                    seen.clear()
                seen.add(key)
                texts.append(text)
                keys.append(key)
            for start, end, words in split(texts):
                rare = _numbers_of(words.different, hot.value) == 0
                at = np.flatnonzero(rare[words.index])
                text_of = np.searchsorted(words.ends, at, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[start:end], pa.binary()).take(pa.array(text_of)),
                        pa.array((at - words.ends[text_of]).astype(np.int32)),
                        pa.array(words.different, pa.string()).take(pa.array(words.index[at])),
                    ],
                    names=["tkey", "place", "word"],
                )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = vocab.spaced_words(source)
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in small_batches(batches):
            texts, out = batch.column("text").to_pylist(), []
            for start, end, words in split(texts):
                numbers = _numbers_of(words.different, hot.value).astype("<u4")[words.index]
                planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 4)[:, :3].T)
                out += [squeeze(planes[:, words.of(i)].tobytes()) for i in range(end - start)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(_key, texts), pa.binary()), pa.array(out, pa.binary())],
                names=["doc_id", "tkey", "numbers"],
            )

    rare = staged(
        docs.select("text").mapInArrow(find_rare, "tkey binary, place int, word string"), "rare-words"
    )
    table = staged(encode_words(rare.select("word").distinct(), source), "word-ids")
    fills = staged(
        rare.join(table, "word")
        .select("tkey", "place", "ids")
        .repartition("tkey")
        .sortWithinPartitions("tkey", "place")
        .mapInArrow(_packed_fills, "tkey binary, fills binary"),
        "fills",
    )
    kind = dict(docs.dtypes)["doc_id"]
    numbered = docs.mapInArrow(number, f"doc_id {kind}, tkey binary, numbers binary")
    return numbered.join(fills, "tkey", "left").select("doc_id", "numbers", "fills"), hot_codes


def encode(
    docs: DataFrame,
    tokenizer_path: str,
    sample_docs: int = SAMPLE_DOCS,
    hot_words: int = HOT_WORDS,
) -> DataFrame:
    """doc_id, n_tokens, ids of every document; ids are little-endian unsigned 32-bit integers."""
    source = vocab.tokenizer_json(tokenizer_path)
    joined, hot = _joined_words(docs, source, sample_docs, hot_words)
    width = vocab.id_type(source)
    schema = f"doc_id {dict(joined.dtypes)['doc_id']}, n_tokens long, ids binary"
    return joined.mapInArrow(lambda batches: _filled(batches, hot.value, width), schema)


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """``encoded`` (with ids as ``encode`` gives them) and the text of its ids as ``decoded``."""
    pieces = vocab.pieces(vocab.tokenizer_json(tokenizer_path))
    table = encoded.sparkSession.sparkContext.broadcast(pieces)
    schema = ", ".join(f"`{c}` {kind}" for c, kind in encoded.dtypes)
    return encoded.mapInArrow(
        lambda batches: _decoded(batches, table.value), f"{schema}, decoded string"
    )


def round_trip(
    docs: DataFrame,
    tokenizer_path: str,
    sample_docs: int = SAMPLE_DOCS,
    hot_words: int = HOT_WORDS,
) -> DataFrame:
    """``decode`` of ``encode``, in one visit to Python."""
    source = vocab.tokenizer_json(tokenizer_path)
    joined, hot = _joined_words(docs, source, sample_docs, hot_words)
    width = vocab.id_type(source)
    table = docs.sparkSession.sparkContext.broadcast(vocab.pieces(source))
    schema = f"doc_id {dict(joined.dtypes)['doc_id']}, n_tokens long, ids binary, decoded string"
    return joined.mapInArrow(
        lambda batches: _decoded(_filled(batches, hot.value, width), table.value), schema
    )


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text that they decode to."""
    return round_trip(docs, tokenizer_path).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
