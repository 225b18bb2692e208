import math
import random
import re
import unicodedata
from collections import Counter

import pytest

from equigauge.llm.weak import BASE, FURTHER, RULES, Fit, Rule, fit, measured, quality_rules, with_quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    found = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if found[w] > 1 for k in range(5)}
    plain = lambda c: unicodedata.category(c)[0] in "LN"
    capital = lambda c: unicodedata.category(c) == "Lu"
    odd = lambda w: (
        any(c in r"#*$%&|<>=_~^\{}[]" for c in w)
        or any(capital(a) and capital(b) for a, b in zip(w, w[1:], strict=False))
        or re.search("[!?]{2}", w) is not None
    )
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_lines": len(lines),
        "n_closed_lines": sum(x.rstrip(" \t\n\x0b\x0c\r")[-1] in ".!?:;\"')" for x in lines),
        "n_capitals": sum(map(capital, text)),
        "n_marks": sum(c in "!?" for c in text),
        "n_bare": sum(not any(map(plain, w)) for w in words),
        "n_odd": sum(map(odd, words)),
    }


def votes(m):
    out = []
    for rule in RULES:
        whole = m[rule.whole]
        value = m[rule.part] / whole if whole else None
        if value is None:
            out.append(None)
        elif value <= rule.bad if rule.falling else value >= rule.bad:
            out.append(0)
        elif rule.good is not None and (value >= rule.good if rule.falling else value <= rule.good):
            out.append(1)
        else:
            out.append(None)
    return tuple(out)


def estimated(patterns, rounds=40):
    """The same estimation in plain Python: share of good documents, and each rule's accuracy."""
    good, right = 0.8, [0.8] * len(next(iter(patterns)))

    def posterior(v):
        of = lambda class_: math.prod(
            1 if x is None else r if x == class_ else 1 - r for x, r in zip(v, right, strict=True)
        )
        return good * of(1) / (good * of(1) + (1 - good) * of(0))

    for _ in range(rounds):
        p = {v: posterior(v) for v in patterns}
        good = (sum(n * p[v] for v, n in patterns.items()) + 1) / (sum(patterns.values()) + 2)
        right = [
            max(0.5, (sum(n * (p[v] if v[j] else 1 - p[v]) for v, n in patterns.items() if v[j] is not None) + 1)
                / (sum(n for v, n in patterns.items() if v[j] is not None) + 2))
            for j in range(len(right))
        ]
    return good, right, posterior


@pytest.fixture
def texts(words):
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    out = [prose(rng.randint(12, 200)) for _ in range(150)]
    out += [" | ".join(rng.choice(words) for _ in range(60)) for _ in range(12)]
    out += [" ".join(rng.choice(words) + "$$$" for _ in range(60)) for _ in range(12)]
    out += [" ".join(rng.choice(words).upper() + "!!" for _ in range(60)) for _ in range(12)]
    out += [(prose(6) + " ") * 20, "x " * 300, "a b c d e f a b c d e", "a b c d e a b c d e", "1 2 3 4 5 6 " * 9]
    out += [None, "", " \n\t", "x", "a\nb\na\n\n \na", "É" * 70_000, ("word" * 20_000 + " ") * 2, "!" * 50_000, "A\x0bB\x0cC\rD  E"]
    out += ["Ünï cødé 漢字 ٣٤ ǅ. " * 4, "-- -- … § a1 1a", "end)\n\"end\"\nopen\n'x';  ", "no break" * 3]
    return out + out[:20]


ROW = "doc_id long, text string, n_words string, posterior2 double, one string, _words string"


def test_measures_votes_and_verdicts(spark, texts):
    docs = spark.createDataFrame([(i // 2, t, "x", 1.0, "y", "z") for i, t in enumerate(texts)], ROW)
    rows = quality_rules(docs).collect()
    assert len(rows) == len(texts)
    names = [*BASE, *FURTHER]
    want = Counter((i // 2, *(measures(t)[n] for n in names)) for i, t in enumerate(texts))
    assert Counter((r["doc_id"], *(r[n] for n in names)) for r in rows) == want
    patterns = Counter(votes(measures(t) | {"one": 1}) for t in texts)
    good, right, posterior = estimated(patterns)
    for r in rows:
        v = tuple(r[f"vote_{x.name}"] for x in RULES)
        assert v == votes({n: r[n] for n in names})
        assert r["posterior"] == pytest.approx(posterior(v), abs=1e-9)
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] is failed
        assert r["kept"] is (not failed and posterior(v) >= 0.5)
    # Prose stays, the three kinds of junk go.
    keep = [r["kept"] for r in with_quality(docs.drop("_words"), "p").orderBy("doc_id").collect()]
    assert sum(keep[:150]) == 150 and not any(keep[150:186])


def test_empty_table_and_clash(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert quality_rules(docs.limit(0)).count() == 0
    assert [r["kept"] for r in quality_rules(docs).collect()] == [False]
    with pytest.raises(ValueError):
        with_quality(docs.withColumnRenamed("doc_id", "kept"))


def test_accuracies_are_found(spark):
    """Votes drawn from known accuracies, nobody's labels given."""
    rng = random.Random(1)
    true, rows = (0.95, 0.85, 0.75, 0.6), []
    for _ in range(20_000):
        good = rng.random() < 0.7
        rows.append(tuple(
            None if rng.random() < 0.3 else int(good if rng.random() < a else not good) for a in true
        ))
    names = [f"v{j}" for j in range(4)]
    table = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names))
    found = fit(table, names, rounds=80)
    assert isinstance(found, Fit) and found.good == pytest.approx(0.7, abs=0.03)
    assert found.right == pytest.approx(true, abs=0.04)
    assert fit(table.limit(0), names) == Fit(0.5, (0.5,) * 4)


def test_rule_bounds(spark):
    rows = [(0, 0), (1, 10), (2, 10), (5, 10), (9, 10), (10, 10)]
    table = spark.createDataFrame(rows, "a long, b long")
    rising, falling = Rule("r", "a", "b", bad=0.5, good=0.1), Rule("f", "a", "b", bad=0.2, good=0.9, falling=True)
    got = [tuple(r) for r in table.select(rising.vote(), falling.vote()).collect()]
    assert got == [(None, None), (1, 0), (None, 0), (0, None), (0, 1), (0, 1)]


def test_no_python_in_the_plan(spark, texts):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    docs.write.mode("overwrite").parquet(spark.conf.get("spark.checkpoint.dir") + "/weak-docs")
    read = spark.read.parquet(spark.conf.get("spark.checkpoint.dir") + "/weak-docs")
    plan = measured(read.withColumnRenamed("text", "_text"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
