import hashlib
import itertools

import pytest
from hypothesis import given, settings, strategies as st

from equigauge.llm.chat import (
    conversation_text, escape, format_turn, format_turns, parse, read_back, unescape,
)

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
pieces = st.lists(st.sampled_from(["</turn>", "\\", "\n", "### ", "user", "a", "</turn", ">", "é"]), max_size=8)


@settings(max_examples=300, deadline=None)
@given(pieces.map("".join), pieces.map("".join))
def test_every_turn_reads_back(role, text):
    rendered, start, length = format_turn(role, text)
    assert parse(rendered) == [(role, text, start, length)]
    assert unescape(rendered[start : start + length]) == text
    assert unescape(escape(text)) == text


def test_only_conflicts_are_escaped():
    assert format_turn("user", "plain \\ text")[0] == "### user\nplain \\ text\n</turn>\n"
    assert format_turn("user", "a </turn> b")[0] == "### user\na \\</turn> b\n</turn>\n"


@pytest.mark.parametrize("bad", ["x", "### user", "### user\nno end", "### user\na\n</turn>", "### user\na</turn>\n"])
def test_other_texts_are_refused(bad):
    with pytest.raises(ValueError):
        parse(bad)


def test_digests(spark):
    said = ["", None, "\\### Assistant: </turn> ok", "a\nb", "\\", "x" * 50_000]
    rows = [(c, t, r, x, "clash") for c, (t, (r, x)) in itertools.product(
        (1, 2, None), enumerate(itertools.product(("user", "assistant", None), said)))]
    rows += [(1, 0, "user", "tie", "clash"), (1, None, "assistant", "first", "clash"), (1, 0, "user", "tie", "clash")]
    formatted = format_turns(spark.createDataFrame(rows, SCHEMA))
    got = {r["conv_id"]: r for r in read_back(formatted).collect()}
    texts = {r["conv_id"]: r["formatted"] for r in conversation_text(formatted).collect()}
    assert set(got) == {1, 2, None}
    for conv_id, row in got.items():
        turns = sorted(
            ((t is not None, t or 0, r or "", x or "") for c, t, r, x, _ in rows if c == conv_id))
        every = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        assert row["n_turns"] == len(turns)
        assert row["turns_sha256"] == hashlib.sha256(every.encode()).hexdigest()
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert [(r, x) for r, x, *_ in parse(texts[conv_id])] == [(r, x) for *_, r, x in turns]
        assert row["formatted_chars"] == len(texts[conv_id])
    assert read_back(format_turns(spark.createDataFrame([], SCHEMA))).count() == 0
