import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from equigauge.llm import quality
from equigauge.llm.quality import features, fit, held_out, training_rows, with_score


def labelled(prose, n=160):
    """Good prose, and junk of three kinds."""
    rows = []
    for i in range(n):
        text, good = prose(20 + i % 60, i), i % 4 > 0
        if not good:
            text = [text.upper().replace(" ", "!! "), text.replace(" ", "&&& "), " | ".join([text[:25]] * 12)][i // 4 % 3]
        rows.append((i, text, int(good)))
    return rows


def test_votes_are_a_weighted_mean_of_exact_neighbours(prose):
    rows = labelled(prose)
    dense = quality._dense([features(t) for _, t, _ in rows])
    model = quality.Model(dense, np.array([g for *_, g in rows]), rank=16)
    assert model.vectors.shape == (len(rows), 16)
    asked = quality._dense([features(prose(40, 1000 + i)) for i in range(7)])
    got = model.score(asked)
    for row, score in zip(asked, got, strict=True):
        own = row @ model.basis
        cosines = model.vectors @ (own / np.linalg.norm(own))
        near = np.argsort(-cosines, kind="stable")[: quality.NEIGHBOURS]
        weights = np.maximum(cosines[near], 1e-3) ** quality.SHARPNESS
        assert score == pytest.approx((weights * model.labels[near]).sum() / weights.sum(), abs=1e-4)


def test_held_out_accuracy(spark, documents, prose):
    rows = labelled(prose, 400)
    docs = documents([(i, t, "s") for i, t, _ in rows])
    labels = spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id long, quality int")
    train = training_rows(docs, labels)
    assert {r["doc_id"] for r in train.collect()} == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    scored = with_score(docs.select("doc_id", "text"), train).filter(held_out(F.col("doc_id"))).collect()
    truth = {i: g for i, _, g in rows}
    assert len(scored) > 50
    assert np.mean([(r["score"] >= quality.THRESHOLD) == truth[r["doc_id"]] for r in scored]) > 0.95


def test_odd_rows(spark, documents, prose):
    rows = labelled(prose, 80)
    model_rows = spark.createDataFrame(rows, "doc_id long, text string, label int")
    odd = [(1, None, None), (2, "", "s"), (3, " \n", "s"), (None, "word " * 40_000, "s"), (5, "é", "s"), (5, "é", "s")]
    docs = documents(odd)
    got = with_score(docs, model_rows, "quality_score")
    assert got.columns == [*docs.columns, "quality_score"]
    scores = [r["quality_score"] for r in got.collect()]
    assert len(scores) == 6 and all(0 <= s <= 1 for s in scores) and scores[4] == scores[5] and scores[0] == scores[1]
    with pytest.raises(ValueError, match="column named score"):
        with_score(docs, model_rows)
    plain = lambda df: df.drop("score")
    assert with_score(plain(documents([])), model_rows).count() == 0
    nothing = with_score(plain(docs), model_rows.limit(0)).collect()
    assert {r["score"] for r in nothing} == {0.5}
    same = with_score(plain(documents([(9, rows[1][1], "s")])), model_rows.filter("doc_id = 1")).first()
    assert same["score"] == 1.0
    assert fit(model_rows, 10).vectors.shape[0] == 10
