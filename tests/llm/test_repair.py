import hashlib
import itertools
import re
import zlib

import pytest
from hypothesis import given, settings, strategies as st

from equigauge.llm import repair
from equigauge.llm.repair import END, audits, damaged, node_before, plans, repair_digests, repaired_turns, walk

LEGAL = re.compile(r"(s?(ua)+)?\Z")
COLUMNS = "conv_id long, turn long, role string, text string, signature string, cost string, _kind string"


def cheapest(signature, most):
    """All edit strings up to a cost, tried one by one: the least cost, then the least string."""
    found = []

    def go(at, cost, edits, initials):
        if cost > most:
            return
        if at == len(signature) and LEGAL.match(initials):
            found.append((cost, edits))
        if len(edits) < 2 * len(signature) + 4:
            for role in "ua":
                go(at, cost + 3, edits + "I", initials + role)
        if at == len(signature):
            return
        symbol = signature[at]
        go(at + 1, cost + 4, edits + "D", initials)
        if symbol != "x":
            extra = 3 if symbol.isupper() else 0
            go(at + 1, cost + extra, edits + "K", initials + symbol.lower())
            for role in "ua":
                go(at + 1, cost + extra + 3, edits + "R", initials + role)

    go(0, 0, "", "")
    return min(found)


def solved(signatures):
    back = sorted(s[::-1] for s in signatures)
    return {s: (cost, audit) for s, cost, audit in walk(back)}


def test_plans_are_the_cheapest_of_all_edits():
    short = ["".join(x) for n in range(4) for x in itertools.product("suaAx", repeat=n)]
    got = solved(short)
    assert set(got) == set(short)
    for signature in short:
        assert got[signature] == cheapest(signature, got[signature][0]), signature


@settings(max_examples=40, deadline=None)
@given(st.text("suaoSUAOx", min_size=4, max_size=5))
def test_longer_plans(signature):
    got = solved([signature])[signature]
    assert got == cheapest(signature, got[0])


def test_shared_suffixes_are_made_once(monkeypatch):
    made = []
    monkeypatch.setattr(repair, "node_before", lambda s, rest: made.append(s) or node_before(s, rest))
    signatures = {"suaua", "uaua", "aua", "xua", "ua", "", "uaUa"}
    got = solved(signatures)
    suffixes = {s[i:] for s in signatures for i in range(len(s))}
    assert len(made) == len(suffixes)
    assert got[""] == (0, "") and got["suaua"] == (0, "KKKKK") and got["xua"] == (4, "DKK")
    assert END[0][0] == 0


def expected(rows, lost=()):
    """conv_id -> the contract's columns, by plain loops."""
    out = {}
    for conv in {r[0] for r in rows} | set(lost):
        mine = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        mine.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1], hashlib.md5(m[2].encode()).digest()))
        turns = {m[0] for m in mine} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        signature, faults, seen = "", [], set()
        for _, role, text in mine:
            shown = text.strip(" \t\n\x0b\x0c\r")
            fault = "b" if not shown else "d" if (role, text) in seen else "t" if shown[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            signature += "x" if fault in ("b", "d") else letter.upper() if fault == "t" else letter
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(mine)]
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        cost, audit = solved([signature])[signature]
        lines, left = [], list(mine)
        for edit in audit:
            even = len([x for x in lines if not x.startswith("s")]) % 2 == 0
            role = "user" if even else "assistant"
            if edit == "I":
                lines.append(f"{role}:")
                continue
            _, said, text = left.pop(0)
            if edit != "D":
                lines.append(f"{said if edit == 'K' else role}:{text}")
        out[conv] = (
            gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
ODD = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Yes."),
    (2, 5, "assistant", "late"), (2, 1, "user", " \t\n"), (2, 1, "user", " \t\n"), (2, None, "tool", "odd!"),
    (3, 0, None, None), (3, 0, "", "no role."), (3, 9, "user", "A." * 30_000), (3, 9, "user", "A." * 30_000),
    (None, None, "user", "x."), (None, 3, "assistant", "y. "), (None, 3, "assistant", "z"),
    (4, None, "user", "null turns."), (4, None, "assistant", "null turns."),
    (5, 1, "user", "tie b."), (5, 1, "user", "tie a."), (5, 1, "assistant", "é"),
    (-(2**63), 2**40, "uber", "kept."), (-(2**63), 0, "usher", "é?"),
]


def test_odd_rows(spark):
    rows = ODD * 2 + [(c, t, r, x) for c in range(10, 80) for t, r, x in [(0, "user", f"q{c % 3}?"), (1, "assistant", "ok.")]]
    turns = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], COLUMNS)
    got = {r["conv_id"]: tuple(r[n] for n in NAMES) for r in repair_digests(turns).collect()}
    assert got == expected(rows)
    assert repair_digests(turns.limit(0)).count() == 0


def test_damage_and_conversations_that_lose_all_rows(spark):
    rows = [(c, t, r, f"Said {t}. And!") for c in range(120) for t, r in enumerate(["user", "assistant"])]
    rows += [(c, None, None, None) for c in range(60)] + [(None, 0, "user", None)]
    rows += [(c, 0, "user", "Alone.") for c in range(200, 280)]
    left = []
    for c, t, r, x in rows:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = (" " if r is None else r), (" " if x is None else x)
        r = "user" if fate == 4 else r
        x = "" if fate == 1 else re.sub("[.!?]", "", x) if fate == 2 else x
        left += [(c, t, r, x)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    turns = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], COLUMNS)
    got = {r["conv_id"]: tuple(r[n] for n in NAMES) for r in repair_digests(damaged(turns)).collect()}
    want = expected(left, {r[0] for r in rows})
    assert got == want
    assert {c for c in want} - {r[0] for r in left}, "no conversation lost all its rows"


def test_repaired_turns_are_legal(spark):
    rows = [r for r in ODD if r[0] is not None]
    turns = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], COLUMNS)
    texts = {}
    for r in repaired_turns(turns, audits(turns)).collect():
        texts.setdefault(r["conv_id"], []).append((r["place"], r["role"], r["text"], r["edit"]))
    for said in texts.values():
        said.sort()
        assert [p for p, *_ in said] == list(range(len(said)))
        assert LEGAL.match("".join(r[0] for _, r, _, _ in said))
        assert all(x == "" for *_, x, e in said if e == "I")


@pytest.mark.parametrize("parts", [1, 7])
def test_hot_and_rare_signatures(spark, parts):
    rows = [("ua",)] * 900 + [("".join(x),) for x in itertools.product("suaAx", repeat=4)] + [("",)] * 3
    table = spark.createDataFrame(rows, "signature string").repartition(parts)
    got = {r["signature"]: (r["conversations"], r["cost"], r["audit"]) for r in plans(table).collect()}
    alone = solved({r[0] for r in rows})
    assert {s: (c, a) for s, (_, c, a) in got.items()} == alone
    assert got["ua"][0] == 900 and got[""][0] == 3
