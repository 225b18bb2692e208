import random
import re

import numpy as np
import pytest

from equigauge.llm import dedup
from equigauge.llm.components import components
from equigauge.llm.dedup import near_duplicates


def shingles(text, width):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not found:
        return frozenset()
    n = min(width, len(found))
    return frozenset(tuple(found[i : i + n]) for i in range(len(found) - n + 1))


def brute(rows, width, percent=80):
    sets = [shingles(t, width) for _, t, _ in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0] and not a and not b
            if a and b and 100 * len(a & b) >= percent * len(a | b) or same_id:
                top[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    out = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        low = min(ids) if ids else None
        out += [(str(rows[i][0]), len(sets[i]), str(low), low is None or rows[i][0] == low) for i in members]
    return sorted(out)


def edited(text, share, seed):
    rng = random.Random(seed)
    return " ".join(f"q{rng.random()}" if rng.random() < share else w for w in text.split())


def corpus(prose):
    rows = [(i, prose(60, i), "s") for i in range(40)]
    base = prose(120, 900)
    rows += [(100 + i, edited(base, 0.002 * (i % 30), i), "s") for i in range(90)]
    chain = prose(100, 901).split()
    rows += [(300 + i, " ".join(chain[i * 4 : i * 4 + 60]), "s") for i in range(8)]
    rows += [(400, prose(60, 3).upper() + "É", "s"), (401, prose(60, 3).replace(" ", "\n\t"), None)]
    rows += [(500 + i, "Two words" if i < 3 else "two  WORDS", "s") for i in range(5)]
    rows += [(600, None, "s"), (601, "", "s"), (602, " \n", "s"), (603, "é É", "s"), (604, "É é", "s")]
    rows += [(None, prose(60, 5), "s"), (None, "alone here without any id", "s"), (700, prose(9000, 8), "s")]
    return [*rows, rows[7], (701, prose(9000, 8) + " end", "s"), (5, prose(30, 77), "s")]


@pytest.mark.parametrize("width", [4, 5])
def test_components_equal_brute_force(documents, prose, width):
    rows = corpus(prose)
    random.Random(2).shuffle(rows)
    got = near_duplicates(documents(rows).repartition(4), width=width).collect()
    assert sorted((str(r[0]), r[1], str(r[2]), r[3]) for r in got) == brute(rows, width)


def test_small_blocks_lose_no_link(documents, prose, monkeypatch):
    monkeypatch.setattr(dedup, "MEMBER_BLOCK", 7)
    monkeypatch.setattr(dedup, "LEFT_BLOCK", 3)
    monkeypatch.setattr(dedup, "HUB_SLICE", 5)
    rows = corpus(prose)
    got = near_duplicates(documents(rows), width=4).collect()
    assert sorted((str(r[0]), r[1], str(r[2]), r[3]) for r in got) == brute(rows, 4)


def test_nothing_to_compare(documents):
    assert near_duplicates(documents([])).count() == 0
    (row,) = near_duplicates(documents([(3, None, "s")])).collect()
    assert tuple(row) == (3, 0, 3, True)


def test_estimate_by_bit_counts(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    low = rng.integers(0, 1 << 32, (2, dedup.HASHES), dtype=np.uint64).astype(np.uint32)
    low[1, :70] = low[0, :70]
    a, b = (dedup.packed_bits(x).tolist() for x in low)
    equal = int(((low[0] & 15) == (low[1] & 15)).sum())
    df = spark.createDataFrame([(a, b), (a, a)], "a array<long>, b array<long>")
    assert [r[0] for r in df.select(dedup.equal_fields(F.col("a"), F.col("b"))).collect()] == [equal, dedup.HASHES]
    assert dedup.least_equal_fields(80) < 0.8125 * dedup.HASHES


def test_long_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (200, 100), (300, 300)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 100}
