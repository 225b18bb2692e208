import collections

import pytest

from equigauge.llm.mixing import mix, mixed_documents


def filled(sizes, weights, share, cap):
    """Targets by resharing what capped sources leave until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        open_weight = sum(weight[s] for s in free)
        target = {s: left * weight[s] / open_weight for s in free} | fixed
        above = [s for s in free if target[s] > cap * sizes[s]]
        if not above:
            return target
        fixed |= {s: float(cap * sizes[s]) for s in above}


def rows(prose):
    out = [(i, prose(1 + i * 7 % 40, i), f"s{i % 5}") for i in range(60)]
    out += [(100 + i, prose(3, i), None) for i in range(4)]
    return out + [(200, None, "s1"), (201, "", "s1"), (None, prose(5), "s2"), (3, prose(22, 3), "s3"), (3, prose(22, 3), "s3")]


def test_targets_and_taken_words(documents, prose):
    given = rows(prose)
    got = mix(documents(given)).collect()
    assert len(got) == len(given)
    by_id = {d: s for d, _, s in given}
    sizes, taken, targets = collections.Counter(), collections.Counter(), {}
    for r in got:
        s = by_id[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        targets[s] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    expected = filled(sizes, (5, 2, 1), 1.5, 2)
    for s in sizes:
        assert targets[s] == pytest.approx(expected[s])
        assert abs(taken[s] - expected[s]) <= 2
    again = mix(documents(given)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_rows_of_the_mix_hold_the_taken_words(documents, prose):
    given = rows(prose)
    docs = documents(given)
    taken = collections.Counter()
    for r in mix(docs).collect():
        taken[r["doc_id"]] += r["taken"]
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = collections.Counter()
    for r in mixed.collect():
        words[r["doc_id"]] += len((r["text"] or "").split())
        assert r["score"] == 1.0
    assert words == +taken
    assert {r["doc_id"] for r in mixed.filter("text IS NULL OR text = ''").collect()} == {200, 201}


def test_empty_and_single(documents, prose):
    assert mix(documents([])).count() == 0 and mixed_documents(documents([])).count() == 0
    (row,) = mix(documents([(1, prose(10), "a")])).collect()
    assert (row["size"], row["source_size"], row["target"], row["taken"]) == (10, 10, 15.0, 15)


def test_a_long_text_is_cut_at_a_word(documents, prose):
    text = prose(60_000)
    mixed = [r["text"] for r in mixed_documents(documents([(1, "\n" + text + " ", "a")])).collect()]
    assert sorted(map(len, (m.split() for m in mixed))) == [30_000, 60_000]
    assert ("\n" + text).startswith(min(mixed, key=len))
