import hashlib

import pytest
from pyspark.sql import functions as F

from equigauge.llm import syncmers
from equigauge.llm.syncmers import anchors, edited_pairs, range_number


def rows(prose):
    out = [(i * 7 % 300 - 20, prose(1 + i * 5 % 90, i), "s") for i in range(150)]
    out += [(1000, None, "s"), (1001, "", "s"), (1002, " \n ", None), (None, "no id at all here", "s"), (1003, "é" * 50_000, "s")]
    return [*out, out[3], (out[4][0], "another text with the same id", "s"), (1004, "a a a a a a a a a a", "s")]


@pytest.mark.parametrize("per_range", [9, 10_000])
def test_edited_texts_and_likeness(documents, prose, monkeypatch, per_range):
    monkeypatch.setattr(syncmers.with_next, "__defaults__", (per_range,))
    given = rows(prose)
    got = edited_pairs(documents(given).repartition(5))
    line = sorted(((d is not None, d or 0, t or ""), d, t or "") for d, t, _ in given)
    want = []
    for i, (_, d, text) in enumerate(line):
        cut, following = len(text) // 4, line[(i + 1) % len(line)][2]
        edited = text[: len(text) - cut] + following[:cut]
        want.append((str(d), len(text), hashlib.sha256(edited.encode()).hexdigest()))
    found = got.collect()
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in found) == sorted(want)
    prints = {}
    for r in found:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        prints.setdefault((r["doc_id"], r["n_chars"]), set()).add(r["fingerprint"])
    assert all(len(x) == 1 for x in prints.values())
    long = [r for r in found if r["n_chars"] > 150 and r["doc_id"] != 1003]
    assert min(r["near_edited"] for r in long) > 0.3 and max(r["near_next"] for r in long) < 0.3
    assert "Python" not in got._jdf.queryExecution().toString()


def test_anchors_are_closed_syncmers(spark, documents, prose):
    text = prose(80, 1)
    words = text.split()
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h"))
    hashes = [{r["w"]: r["h"] for r in df.collect()}[w] for w in words]
    k = syncmers.K
    want = {i + 1 for i in range(len(words) - k + 1) if min(hashes[i : i + k]) in (hashes[i], hashes[i + k - 1])}
    assert {r["place"] for r in anchors(documents([(1, text, "s")])).collect()} == want
    moved = {r["anchor"] for r in anchors(documents([(1, "new words before " + text, "s")])).collect()}
    assert {r["anchor"] for r in anchors(documents([(1, text, "s")])).collect()} <= moved


def test_small_tables(documents):
    assert edited_pairs(documents([])).count() == 0
    (row,) = edited_pairs(documents([(1, "abcd efgh ijkl", "s")])).collect()
    assert row["near_next"] == 1.0 and row["n_chars"] == 14
    (row,) = edited_pairs(documents([(1, None, "s")])).collect()
    assert (row["fingerprint"], row["near_edited"], row["near_next"]) == ("", 1.0, 1.0)
    both = edited_pairs(documents([(1, "", "s"), (2, "a b", "s")])).collect()
    assert {r["near_next"] for r in both} == {0.0}


def test_ranges_by_halving(spark):
    bounds = [-5, 0, 7, 7 + 2**40]
    ids = [-10, -5, -4, 0, 1, 7, 8, 2**50, None]
    df = spark.createDataFrame([(i,) for i in ids], "i long")
    got = [r[0] for r in df.select(range_number(F.col("i"), bounds)).collect()]
    assert got == [0 if i is None else sum(b < i for b in bounds) for i in ids]


def test_long_texts_share_what_they_share(documents, prose):
    shared = prose(20, 5)
    texts = [prose(900, 1) + " " + shared, shared + " " + prose(900, 2)]
    got = edited_pairs(documents([(i, t, "s") for i, t in enumerate(texts)])).orderBy("doc_id").collect()
    sets = [{r["anchor"] for r in anchors(documents([(1, t, "s")])).collect()} for t in texts]
    assert [len(r["fingerprint"]) for r in got] == [16 * len(x) for x in sets]
    want = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    assert want > 0 and [r["near_next"] for r in got] == [pytest.approx(want)] * 2


def test_short_texts_and_texts_without_spaces(documents, words):
    rng = __import__("random").Random(4)
    unbroken = "".join(rng.choice("etaoinshrdlu") for _ in range(3000))
    texts = ["considerable differences remained", unbroken, "two measurements everywhere", "unquestionable"]
    got = edited_pairs(documents([(i, t, "s") for i, t in enumerate(texts)])).collect()
    assert all(0.3 < r["near_edited"] < 1 for r in got) and all(r["near_next"] < 0.2 for r in got)
