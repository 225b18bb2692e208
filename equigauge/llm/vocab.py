"""Public tokenizers inside Spark tasks: word splitting, and codes of words.

A tokenizer reaches the tasks as the text of its JSON file, which is a few megabytes whatever the
data. Texts of common characters are split by a compiled pattern that says what the tokenizer's
own rule says for them; all other texts, and texts that hold a special token, take the library's
own path. The tests compare the two for every common character.

Many texts are split at once, as arrays: common characters are one byte each, words begin where the
kind of character changes, and Arrow finds the different words. Python sees each of those once for
some ``CHUNK`` characters of text.
"""

from __future__ import annotations

import codecs
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
from tokenizers import Tokenizer  # noqa: E402

#: Anything but ASCII text and Latin-1 letters and signs whose class is the same in every library.
UNCOMMON = re.compile(
    "[^\t\n\x0b\x0c\r -~\xa1-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-\xff]"
)
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
SPACES = " \t\n\x0b\x0c\r"
ENDINGS = "'(?:s|t|re|ve|m|ll|d)"
#: Words with the space before them; of a run of spaces, the last goes with the next word.
SPACED_WORDS = re.compile(
    f"(?: ?[{LETTERS}]+)|{ENDINGS}| ?[0-9]+| ?[^{SPACES}{LETTERS}0-9]+"
    f"|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)
#: Words without white space, for lower-cased text; digits stand alone.
BARE_WORDS = re.compile(f"[{LETTERS}]+|{ENDINGS}|[0-9]|[^{SPACES}{LETTERS}0-9]+")

#: Characters that are split at a time (a longer text by itself), an eighth with spaces kept, where tasks
#: hold frequent words as well. The arrays take some ten times that.
CHUNK = 4_000_000
COMMON = bytes(c for c in range(256) if not UNCOMMON.search(chr(c)))
LOWER = np.array([ord(chr(c).lower()) for c in range(256)], np.uint8)
#: Kinds of characters; a zero byte stands between texts, which have none.
GAP, BLANK, LETTER, DIGIT, SIGN = range(5)
KINDS = np.full(256, SIGN, np.uint8)
for _kind, _pattern in ((LETTER, f"[{LETTERS}]"), (DIGIT, "[0-9]"), (BLANK, f"[{SPACES}]"), (GAP, "\0")):
    KINDS[[c for c in range(256) if re.match(_pattern, chr(c))]] = _kind

_loaded: dict[str, Tokenizer] = {}


def tokenizer_json(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def load(source: str) -> Tokenizer:
    """The tokenizer of a JSON text, kept for the life of the Python worker."""
    if source not in _loaded:
        _loaded[source] = Tokenizer.from_str(source)
        _loaded[source].no_truncation()
        _loaded[source].no_padding()
    return _loaded[source]


@lru_cache(maxsize=4)
def special_tokens(source: str) -> dict[str, int]:
    return {t["content"]: t["id"] for t in json.loads(source)["added_tokens"]}


def special_pattern(source: str) -> re.Pattern:
    marks = sorted(special_tokens(source), key=lambda t: (-len(t), t))
    return re.compile("|".join(map(re.escape, marks)) if marks else r"(?!)")


def spaced_splitter(source: str) -> Callable[[str], list[str]]:
    """Splits a text into the words that the tokenizer encodes one by one.

    For byte-level tokenizers whose words keep their leading space. Joined, the words are the text.
    """
    tokenizer, special, common = load(source), special_pattern(source), SPACED_WORDS.findall
    plain = "<|"

    def by_library(text: str) -> list[str]:
        words, at = [], 0
        for mark in [*special.finditer(text), None]:
            part = text[at : mark.start() if mark else len(text)]
            if part:
                spans = tokenizer.pre_tokenizer.pre_tokenize_str(part)
                words += [part[a:b] for _, (a, b) in _whole_characters(spans)]
            if mark:
                words.append(mark[0])
                at = mark.end()
        return words

    def split(text: str) -> list[str]:
        if UNCOMMON.search(text) or plain in text:
            return by_library(text)
        return common(text)

    return split


def _whole_characters(spans):
    return [s for s in spans if s[1][0] < s[1][1]]


class Words(NamedTuple):
    """Words of some texts: each once, the place of every word among those, and where texts end.

    Words of single-byte texts are bytes, others text.
    """

    different: list[str] | list[bytes]
    index: np.ndarray
    ends: np.ndarray

    def of(self, text: int) -> slice:
        """The words of a text, from 0, within ``index``."""
        return slice(self.ends[text], self.ends[text + 1])


def ranges(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose sizes add up to ``limit`` at most; a larger one stands alone."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def _single_bytes(text: str) -> bytes | None:
    """A text of common characters, a byte each; None if the library must split it."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return None
    return None if b"<|" in raw or raw.translate(None, COMMON) else raw


def _beginnings(data: np.ndarray, kinds: np.ndarray, spaced: bool) -> np.ndarray:
    """Where ``SPACED_WORDS`` or ``BARE_WORDS`` begin a match; ``data`` ends with two zero bytes."""
    begins = np.ones(len(data), bool)
    np.not_equal(kinds[1:], kinds[:-1], out=begins[1:])
    if spaced:
        last = np.flatnonzero((kinds[:-1] == BLANK) & (kinds[1:] > BLANK))
        begins[last] = True
        begins[last[data[last] == 0x20] + 1] = False
    else:
        begins |= kinds == DIGIT
    quotes = np.flatnonzero((data == 0x27) & begins)
    after, then = data[quotes + 1], data[quotes + 2]
    one = np.isin(after, np.frombuffer(b"stmd", np.uint8))
    two = np.isin(after, np.frombuffer(b"rv", np.uint8)) & (then == ord("e"))
    two |= (after == ord("l")) & (then == ord("l"))
    begins[quotes[one | two] + 1] = False
    begins[quotes[one] + 2] = True
    begins[quotes[two] + 3] = True
    return begins


def _split_bytes(raws: list[bytes], spaced: bool) -> Words:
    """Words of single-byte texts, those of ``BARE_WORDS`` in lower case."""
    data = np.frombuffer(b"\0".join([*raws, b"", b""]), np.uint8)
    if not spaced:
        data = LOWER[data]
    kinds = KINDS[data]
    begins, kept = _beginnings(data, kinds, spaced), kinds > (GAP if spaced else BLANK)
    gaps = np.cumsum([len(x) + 1 for x in raws]) - 1
    ends = np.searchsorted(np.flatnonzero(begins & kept), gaps)
    left = data[kept]
    offsets = np.append(np.flatnonzero(begins[kept]), len(left)).astype(np.int32)
    words = pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(left)]
    ).dictionary_encode()
    different = words.dictionary.to_numpy(zero_copy_only=False).tolist()
    return Words(different, words.indices.to_numpy(), np.append(0, ends))


def _split_common(texts: list[str], spaced: bool, chunk: int) -> Iterator[tuple[int, int, Words, list[int]]]:
    """Ranges of the texts and their words, and which of a range are not split but left to the library."""
    for start, end in ranges([len(t) for t in texts], chunk):
        raws = [_single_bytes(t) for t in texts[start:end]]
        odd = [i for i, raw in enumerate(raws) if raw is None]
        yield start, end, _split_bytes([raw or b"" for raw in raws], spaced), odd


def spaced_words(source: str) -> Callable[[list[str]], Iterator[tuple[int, int, Words]]]:
    """Splits many texts as ``spaced_splitter`` does: ranges of the texts, and their words."""
    split = spaced_splitter(source)

    def words_of(texts: list[str]) -> Iterator[tuple[int, int, Words]]:
        for start, end, words, odd in _split_common(texts, spaced=True, chunk=CHUNK // 8):
            words = words._replace(different=[w.decode("latin-1") for w in words.different])
            if odd:
                places = {w: i for i, w in enumerate(words.different)}
                parts = [words.index[words.of(i)] for i in range(end - start)]
                for i in odd:
                    parts[i] = [places.setdefault(w, len(places)) for w in split(texts[start + i])]
                ends = np.cumsum([0, *map(len, parts)])
                words = Words(list(places), np.concatenate(parts).astype(np.int32), ends)
            yield start, end, words

    return words_of


class Codes:
    """Packed ids of numbered words, all in one array."""

    def __init__(self, codes: list[bytes], kind: str):
        width = array(kind).itemsize
        self.ids = np.frombuffer(b"".join(codes), f"<u{width}")
        self.sizes = np.fromiter(map(len, codes), np.int64, len(codes)) // width
        self.begins = np.cumsum(self.sizes) - self.sizes


def gathered(ids: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of ``ids`` one after the other, and where each ends, from 0."""
    ends = np.append(0, np.cumsum(sizes))
    places = np.repeat(begins - ends[:-1], sizes)
    places += np.arange(ends[-1])
    return ids[places], ends


def _byte_characters() -> str:
    """The character that stands for each byte in the pieces of a byte-level tokenizer."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = iter(range(256, 512))
    return "".join(chr(b) if b in kept else chr(next(moved)) for b in range(256))


def word_codes(source: str, words: list[str], kind: str = "H") -> list[bytes]:
    """The ids of each word as packed integers of array type ``kind``.

    A word is what the tokenizer's own splitter makes, so its model encodes it by itself.
    """
    if not words:
        return []
    if load(source).normalizer is None:
        return bare_word_codes(source, words, kind)
    return [array(kind, x.ids).tobytes() for x in load(source).encode_batch(words, add_special_tokens=False)]


def bare_word_codes(source: str, words: list[str], kind: str = "H") -> list[bytes]:
    """As ``word_codes``, for words that the tokenizer's normaliser would leave as they are."""
    tokenize, special, characters = load(source).model.tokenize, special_tokens(source), _byte_characters()

    def ids(word: str) -> list[int]:
        if word in special:
            return [special[word]]
        return [t.id for t in tokenize(codecs.charmap_decode(word.encode(), "strict", characters)[0])]

    return [array(kind, ids(w)).tobytes() for w in words]


class LowerCaseCoder:
    """Packed ids of whole texts, for tokenizers that lower-case and drop white space.

    Codes of words are remembered up to ``limit`` words; then the memory starts anew.
    """

    def __init__(self, source: str, kind: str = "H", limit: int = 900_000):
        self.source, self.kind, self.limit = source, kind, limit
        self.codes: dict[bytes, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array(self.kind, load(self.source).encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]

    def many(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        out = []
        for start, end, words, odd in _split_common(texts, spaced=False, chunk=CHUNK):
            table = Codes(self._of_words(words.different), self.kind)
            ids, ends = gathered(table.ids, table.begins[words.index], table.sizes[words.index])
            cuts = ends[words.ends].tolist()
            parts = [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]  # noqa: B905
            for i in odd:
                parts[i] = self.whole(texts[start + i])
            out += parts
        return out

    def _of_words(self, words: list[bytes]) -> list[bytes]:
        """The codes of different single-byte words."""
        found = list(map(self.codes.get, words))
        new = [i for i, code in enumerate(found) if code is None]
        made = bare_word_codes(self.source, [words[i].decode("latin-1") for i in new], self.kind)
        if len(self.codes) + len(new) > self.limit:
            self.codes.clear()
        for i, code in zip(new, made, strict=True):
            found[i] = self.codes[words[i]] = code
        return found


_coders: dict[tuple[str, str], LowerCaseCoder] = {}


def lower_case_coder(source: str, kind: str = "H") -> LowerCaseCoder:
    if (source, kind) not in _coders:
        _coders[source, kind] = LowerCaseCoder(source, kind)
    return _coders[source, kind]


def id_type(source: str) -> str:
    """Array type that holds every id and one value more: unsigned 16 bits if that is enough."""
    model = json.loads(source)["model"]["vocab"]
    highest = max([*model.values(), *special_tokens(source).values()], default=0)
    return "H" if highest < 0xFFFF else "I"


def pieces(source: str) -> list[bytes]:
    """The id-to-piece table of a byte-level tokenizer: the bytes of every id."""
    byte_of = {c: b for b, c in enumerate(_byte_characters())}
    vocab = json.loads(source)["model"]["vocab"] | special_tokens(source)
    table = [b""] * (max(vocab.values(), default=-1) + 1)
    for piece, number in vocab.items():
        known = all(c in byte_of for c in piece)
        table[number] = bytes(byte_of[c] for c in piece) if known else piece.encode()
    return table
