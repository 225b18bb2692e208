"""Quality classifier by nearest-neighbour voting on latent-semantic vectors.

Model: of the labelled rows, at most ``SAMPLE_ROWS`` are drawn by a hash of their id. Their texts
become counts of hashed features (words, shapes of words, lengths), damped by a logarithm and
scaled to length one; a truncated singular value decomposition of these rows gives ``RANK`` latent
directions. The sample's latent vectors and labels, and the projection, are sent to all tasks:
``FEATURES`` x ``RANK`` and ``SAMPLE_ROWS`` x ``RANK`` small numbers, whatever the corpus.

Score: every document is projected likewise, its cosine products with all sample vectors are
computed exactly, in blocks of documents, and the labels of the ``NEIGHBOURS`` nearest are
averaged with weights that grow with the cosine. Nothing but the text enters the score, and a text
is scored whole.

Defined cases: a null text is empty; an empty text has only the length feature and so meets the
shortest texts; without labelled rows every score is the prior 0.5; ties of the cosine are broken
by the order of the sample; repeated rows get equal scores; an empty table gives an empty result;
other columns are handed on by ``with_score``.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from equigauge.llm.common import drawn, read_table, small_batches

FEATURES = 2_048
RANK = 48
SAMPLE_ROWS = 4_096
NEIGHBOURS = 25
#: Cosines are raised to this power as weights of votes.
SHARPNESS = 4.0
BLOCK = 512
THRESHOLD = 0.7
_SHAPES = ((re.compile(r"[A-Z\xc0-\xd6\xd8-\xde]+"), "A"), (re.compile(r"[^\W\dA-Z_]+"), "a"), (re.compile(r"\d+"), "9"))

_slots: dict[str, tuple[int, int]] = {}


def _slots_of(word: str) -> tuple[int, int]:
    """Slots of a word and of its shape; short words are remembered."""
    found = _slots.get(word)
    if found is None:
        shape = word[:64]
        for pattern, mark in _SHAPES:
            shape = pattern.sub(mark, shape)
        half = FEATURES // 2
        found = (
            zlib.crc32(word.lower().encode()) % half,
            half + zlib.crc32(shape.encode()) % (half - 64),
        )
        if len(word) <= 24:
            if len(_slots) >= 200_000:
                _slots.clear()
            _slots[word] = found
    return found


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text, of length one."""
    counts = Counter((text or "").split())
    slots: dict[int, float] = {}
    total = lines = 0
    for word, n in counts.items():
        a, b = _slots_of(word)
        slots[a] = slots.get(a, 0) + n
        slots[b] = slots.get(b, 0) + n
        total += n
    # The last slots hold how long the text is, how often words repeat, and how long they are.
    lines = (text or "").count("\n")
    repeats = total / max(1, len(counts))
    width = len(text or "") / max(1, total)
    keys = [FEATURES - 64 + min(15, int(math.log2(1 + total)))]
    keys.append(FEATURES - 48 + min(15, int(4 * math.log2(repeats or 1))))
    keys.append(FEATURES - 32 + min(15, int(width)))
    keys.append(FEATURES - 16 + min(15, int(math.log2(1 + lines))))
    at = np.fromiter(slots, np.int64, len(slots))
    values = np.log1p(np.fromiter(slots.values(), np.float64, len(slots)))
    words_part = at < FEATURES // 2
    for part, weight in ((words_part, 1.0), (~words_part, 1.0)):
        norm = np.linalg.norm(values[part])
        if norm:
            values[part] *= weight / norm
    at = np.concatenate([at, keys])
    values = np.concatenate([values, np.full(len(keys), 0.3)])
    return at, (values / np.linalg.norm(values)).astype(np.float32)


def _dense(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    out = np.zeros((len(rows), FEATURES), np.float32)
    for row, (at, values) in zip(out, rows, strict=True):
        np.add.at(row, at, values)
    return out


class Model:
    """Projection, latent vectors of the sample and their labels."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, rank: int = RANK):
        self.labels = labels.astype(np.float64)
        if not len(rows):
            self.basis = self.vectors = None
            return
        # Subspace iteration from a fixed start: the same sample gives the same model.
        rng = np.random.default_rng(7)
        basis = rng.standard_normal((rows.shape[1], min(rank + 8, *rows.shape))).astype(np.float32)
        for _ in range(6):
            basis, _r = np.linalg.qr(rows.T @ (rows @ basis))
        small = rows @ basis
        _u, _s, turn = np.linalg.svd(small, full_matrices=False)
        self.basis = np.ascontiguousarray((basis @ turn.T)[:, :rank], np.float64)
        self.vectors = self._unit(rows @ self.basis)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def score(self, rows: np.ndarray) -> np.ndarray:
        if self.vectors is None:
            return np.full(len(rows), 0.5)
        cosines = self._unit(rows @ self.basis) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argsort(-cosines, axis=1, kind="stable")[:, :k] if k == len(self.labels) else (
            np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        )
        weights = np.maximum(np.take_along_axis(cosines, near, axis=1), 1e-3) ** SHARPNESS
        # Nine digits, so that equal texts get equal scores wherever they stand in a block.
        return np.round((weights * self.labels[near]).sum(axis=1) / weights.sum(axis=1), 9)


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model of (doc_id, text, label); the sample is bounded in rows and in numbers per row."""
    rows = labelled.filter(F.col("label").isNotNull()).select("doc_id", "text", "label")

    def sparse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [features(t) for t in part["text"]]
            yield pd.DataFrame(
                {"doc_id": part["doc_id"], "label": part["label"], "at": [f[0] for f in found], "value": [f[1] for f in found]}
            )

    schema = "doc_id long, label int, at array<long>, value array<float>"
    found = drawn(rows, "doc_id", sample_rows).mapInPandas(sparse, schema).toArrow().to_pylist()
    rows = sorted(found, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["label"], r["at"]))
    dense = _dense([(np.array(r["at"], np.int64), np.array(r["value"], np.float32)) for r in rows])
    return Model(dense, np.array([r["label"] for r in rows]))


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from; those without an id are among them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, label of the labelled documents that may be learned from."""
    known = (
        labels.filter(F.col("quality").isNotNull())
        .select("doc_id", F.col("quality").cast("int").alias("label"))
        .filter(~held_out(F.col("doc_id")))
    )
    # Ids first: only the texts that are drawn are ever moved.
    few = drawn(known, "doc_id", SAMPLE_ROWS)
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")


def with_score(docs: DataFrame, labelled: DataFrame, name: str = "score") -> DataFrame:
    """``docs`` and the score of their texts, by a model of ``labelled`` (doc_id, text, label).

    A column that is called like the score is refused, not replaced.
    """
    if name in docs.columns:
        raise ValueError(f"the documents have a column named {name}")
    sent = docs.sparkSession.sparkContext.broadcast(fit(labelled))
    rows = docs
    at = rows.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in small_batches(batches, BLOCK):
            texts = batch.column(at).to_pylist()
            found = model.score(_dense([features(t) for t in texts])) if texts else []
            yield batch.append_column(name, pa.array(found, pa.float64()))
        _slots.clear()

    return rows.mapInArrow(score, StructType([*rows.schema.fields, StructField(name, DoubleType())]))


def query(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labelled = training_rows(docs, read_table(spark, sf_dir, "labels"))
    return with_score(docs, labelled).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
