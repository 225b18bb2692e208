import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from equigauge.llm import bpe, tokens, vocab

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def sources():
    return vocab.tokenizer_json(BYTE), vocab.tokenizer_json(WORD)


def strange_texts():
    rng = random.Random(1)
    pool = [chr(c) for c in [*range(1, 0x180), 0x301, 0x3A3, 0x130, 0x2028, 0x3000, 0x4E2D, 0x1F600, 0x661, 0x2160]]
    out = ["".join(rng.choice(pool if rng.random() < 0.4 else " \n'stredlvmab1.,<|>") for _ in range(rng.randint(0, 30)))
           for _ in range(400)]
    return [*out, "", "  ", "a<|endoftext|>b <|startoftext|>", "x" * 30_000, "don't WE'LL  it's\n\n 12 34th"]


def test_words_as_the_library_splits_them(sources):
    byte, word = sources
    split, code, table = vocab.spaced_splitter(byte), vocab.LowerCaseCoder(word), vocab.pieces(byte)
    common = [chr(c) for c in range(0x250) if not vocab.UNCOMMON.search(chr(c))]
    texts = strange_texts() + [s for c in common for s in (c, f"a{c}b", f" {c} x", c + c, f"1{c}2", f"'{c}", c.upper() + "'S")]
    for text in texts:
        ids = vocab.load(byte).encode(text, add_special_tokens=False).ids
        parts = split(text)
        assert "".join(parts) == text
        assert np.frombuffer(b"".join(vocab.word_codes(byte, parts)), "<u2").tolist() == ids
        decoded = b"".join(table[i] for i in ids).decode("utf-8", "replace")
        assert decoded == vocab.load(byte).decode(ids, skip_special_tokens=False)
        assert np.frombuffer(code(text), "<u2").tolist() == vocab.load(word).encode(text, add_special_tokens=False).ids


def test_many_texts_are_split_as_each_alone(sources, monkeypatch):
    byte, word = sources
    quotes = ["'s", "''s", "a's's'll", "1're", "x 's", "\n's", "a'sb", "'", "'l", "!'t", "  's \n", "\t\tb", " \n", "É'S"]
    texts = [*strange_texts(), *quotes, "", "", *quotes]
    split, whole = vocab.spaced_splitter(byte), vocab.load(word)
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    for chunk in (2, 64, 1 << 20):
        monkeypatch.setattr(vocab, "CHUNK", chunk)
        got, seen = [], []
        for start, end, words in vocab.spaced_words(byte)(texts):
            assert len(set(words.different)) == len(words.different)
            got += [[words.different[k] for k in words.index[words.of(i)]] for i in range(end - start)]
            seen += range(start, end)
        assert got == [split(t) for t in texts] and seen == list(range(len(texts)))
        packed = vocab.LowerCaseCoder(word, limit=50).many(texts)
        assert [np.frombuffer(x, "<u2").tolist() for x in packed] == want


def test_words_are_split_in_small_ranges(sources, monkeypatch):
    """Workers that hold the frequent words split few texts at a time (memory of the pipeline's encode)."""
    monkeypatch.setattr(vocab, "CHUNK", 8_000)
    texts = ["word " * 50] * 40 + ["long " * 400, "end"]
    found = [(start, end) for start, end, _ in vocab.spaced_words(sources[0])(texts)]
    assert [a for a, _ in found[1:]] == [b for _, b in found[:-1]] and found[-1][1] == len(texts)
    assert all(sum(map(len, texts[a:b])) <= 1_000 or b - a == 1 for a, b in found)


def test_known_words_are_looked_up_once_for_many_texts(sources):
    """The cost of op9: a word met again in a batch costs no look-up, a word known no encoding."""
    coder, asked = vocab.LowerCaseCoder(sources[1]), []

    class Codes(dict):
        def get(self, key, default=None):
            asked.append(key)
            return super().get(key, default)

    coder.codes = Codes()
    first = coder.many(["One two, two one."] * 500)
    assert sorted(asked) == [b",", b".", b"one", b"two"] and len(set(first)) == 1
    assert coder.many(["two"]) == [coder.whole("two")] and len(coder.codes) == 4


def rows(prose):
    texts = [*strange_texts(), *[prose(300, i) for i in range(20)], prose(8000), None]
    out = [(i * 3 % 500, t, "s") for i, t in enumerate(texts)]
    return [*out, (None, "no id", "s"), out[5], out[5]]


@pytest.mark.parametrize("hot_words", [1, 200, 100_000])
def test_round_trip_equals_the_library(documents, prose, sources, hot_words):
    given, tokenizer = rows(prose), vocab.load(sources[0])
    docs = documents(given).repartition(3)
    got = bpe.round_trip(docs, BYTE, hot_words=hot_words).collect()
    want = []
    for d, t, _ in given:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.append((str(d), len(ids), np.array(ids, "<u4").tobytes(), tokenizer.decode(ids, skip_special_tokens=False)))
    assert sorted((str(r["doc_id"]), r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in got) == sorted(want)


def test_codes_are_filled_in_for_many_rows_at_once(monkeypatch):
    """The last step of op3 on rows of several ranges: frequent words by number, others from the fills."""
    hot, squeeze = vocab.Codes([b"", b"\1\0", b"\2\0\3\0"], "H"), zstandard.ZstdCompressor().compress
    numbers = [[1, 2], [], [0, 1, 0], [2] * 9]
    planes = [squeeze(bytes(x) + bytes(2 * len(x))) for x in numbers]
    fills = squeeze(np.array([2, 4, 2], "<u4").tobytes() + b"\7\0\x08\0\x09\0")
    schema = pa.schema([("doc_id", pa.int64()), ("numbers", pa.binary()), ("fills", pa.binary())])

    def ids_of(*fills):
        batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(planes), pa.array(fills)], schema=schema)
        rows = [row for out in bpe._filled([batch], hot, "H") for row in out.to_pylist()]
        return [(r["doc_id"], r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist()) for r in rows]

    want = [[1, 2, 3], [], [7, 8, 1, 9], [2, 3] * 9]
    for words in (1, 4, 1000):
        monkeypatch.setattr(bpe, "FILLED_WORDS", words)
        assert ids_of(None, None, fills, None) == [(i, len(x), x) for i, x in enumerate(want)]
    with pytest.raises(ValueError):
        ids_of(None, None, None, fills)


def test_encode_then_decode(documents, prose):
    docs = documents([(1, prose(50), "s"), (2, "é <|endoftext|>", None)])
    back = bpe.decode(bpe.encode(docs, BYTE), BYTE)
    assert {r["doc_id"]: r["decoded"] for r in back.collect()} == {1: prose(50), 2: "é <|endoftext|>"}
    assert bpe.digests(documents([]), BYTE).count() == 0
    (row,) = bpe.digests(documents([(1, None, "s")]), BYTE).collect()
    nothing = hashlib.sha256(b"").hexdigest()
    assert (row["n_tokens"], row["ids_sha256"], row["decoded_sha256"]) == (0, nothing, nothing)


@pytest.mark.parametrize("bits", [False, True])
def test_planes(bits):
    rng = np.random.default_rng(3)
    for kind in ("<u2", "<u4"):
        for n in (0, 1, 7, 8, 4096):
            ids = rng.integers(0, 50_000, n).astype(kind)
            packed = tokens.pack_block(ids, bits)
            assert (tokens.unpack_block(packed) == ids).all()
    with pytest.raises(ValueError):
        tokens.unpack_block(b"????" + packed[4:])


@pytest.mark.parametrize("block, per_shard, bits", [(64, 50, True), (1000, 10_000, False)])
def test_files_in_order_of_ids(documents, prose, sources, tmp_path, block, per_shard, bits):
    given, tokenizer = rows(prose), vocab.load(sources[1])
    path = str(tmp_path / "blocks")
    tokens.blocks(documents(given), WORD, block=block, docs_per_shard=per_shard, bits=bits).write.parquet(path)
    got = tokens.read_documents(documents([]).sparkSession.read.parquet(path)).collect()
    encoded = [(d, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for d, t, _ in given]
    encoded.sort(key=lambda x: (x[0] is not None, x[0] or 0, np.array(x[1], "<u2").tobytes()))
    want, start = [], 0
    for d, ids in encoded:
        want.append((str(d), start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((str(r["doc_id"]), r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(want)


def test_no_documents_no_blocks(documents):
    made = tokens.blocks(documents([]), WORD)
    assert made.count() == 0 and tokens.read_documents(made).count() == 0
    assert made.filter(F.col("n_ids") == 0).count() == 0
