r"""Chat formatting with a grammar round trip.

Grammar of the rendered text, one production per line::

    conversation := turn*
    turn         := "### " role "\n" body "\n</turn>\n"

``body`` must not hold an end mark, which is ``</turn>`` without a backslash before it; a
backslash before ``</turn>`` (or before more backslashes and ``</turn>``) is dropped on reading.
``role`` stands on one line; in it ``\n`` and ``\\`` are escapes.

Each turn is rendered as it is, read back by the parser, and compared with its source. Only where
the two differ is the text escaped (one backslash more before every ``</turn>``, whatever
backslashes stand there already) and compared again; a turn that still differed would be an error,
never a silent change. Turns are rendered in parallel, without a shuffle. Reading back streams
the turns of a conversation in order with a running digest, so a conversation of any length needs
the memory of one turn.

Defined cases: a null text is empty; a null role is the empty role; turns sort by turn (null
first), then role, then text; repeated rows are turns of their own; rows with a null conv_id are
one conversation; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equigauge.llm.common import read_table

HEAD, END = "### ", "\n</turn>\n"
LOSS_ROLE = "assistant"
_MARK = re.compile(r"\\*</turn>")
_OPEN_MARK = re.compile(r"(?<!\\)</turn>")
_ESCAPED_MARK = re.compile(r"\\(\\*</turn>)")
_ROLE_ESCAPE = re.compile(r"\\(.)")

TURN_SCHEMA = (
    "conv_id long, turn long, role string, text string, formatted string, "
    "loss_start int, loss_length int"
)
DIGEST_SCHEMA = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long"
)


def escape(text: str) -> str:
    return _MARK.sub(r"\\\g<0>", text)


def unescape(body: str) -> str:
    return _ESCAPED_MARK.sub(r"\1", body)


def render_turn(role: str, body: str) -> tuple[str, int]:
    """The rendered turn and where its body starts."""
    head = HEAD + role.replace("\\", "\\\\").replace("\n", "\\n") + "\n"
    return head + body + END, len(head)


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """Turns of a rendered text: role, text, start and length of the body.

    Raises ValueError where the text doesn't follow the grammar.
    """
    turns, at = [], 0
    while at < len(rendered):
        line = rendered.find("\n", at)
        if not rendered.startswith(HEAD, at) or line < 0:
            raise ValueError(f"no turn starts at {at}")
        mark = _OPEN_MARK.search(rendered, line)
        if not mark or rendered[mark.start() - 1 : mark.end() + 1] != END or mark.start() - 1 < line + 1:
            raise ValueError(f"the turn at {at} does not end")
        role = _ROLE_ESCAPE.sub(
            lambda m: "\n" if m[1] == "n" else m[1], rendered[at + len(HEAD) : line]
        )
        start, stop = line + 1, mark.start() - 1
        turns.append((role, unescape(rendered[start:stop]), start, stop - start))
        at = mark.end() + 1
    return turns


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn that reads back as its source: rendered text, start and length of its body."""
    for body in (text, escape(text)):
        rendered, start = render_turn(role, body)
        try:
            if parse(rendered) == [(role, text, start, len(body))]:
                return rendered, start, len(body)
        except ValueError:
            continue
    raise ValueError("a turn can't be written so that it reads back as its source")


def _format_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roles = [x or "" for x in batch.column("role").to_pylist()]
        texts = [x or "" for x in batch.column("text").to_pylist()]
        done = [format_turn(r, t) for r, t in zip(roles, texts, strict=True)]
        masked = [r == LOSS_ROLE for r in roles]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("conv_id"),
                batch.column("turn"),
                pa.array(roles, pa.string()),
                pa.array(texts, pa.string()),
                pa.array([x[0] for x in done], pa.string()),
                pa.array([x[1] for x in done], pa.int32()),
                pa.array([x[2] if m else 0 for x, m in zip(done, masked, strict=True)], pa.int32()),
            ],
            names=["conv_id", "turn", "role", "text", "formatted", "loss_start", "loss_length"],
        )


def format_turns(turns: DataFrame) -> DataFrame:
    """Every turn rendered, with the span of it that a loss counts (empty but for assistants)."""
    return turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"
    ).mapInArrow(_format_batches, TURN_SCHEMA)


def conversation_text(formatted: DataFrame) -> DataFrame:
    """conv_id and the whole rendered conversation, for conversations that fit in a row."""
    parts = F.sort_array(F.collect_list(F.struct("turn", "role", "text", "formatted")))
    return formatted.groupBy("conv_id").agg(
        F.array_join(F.transform(parts, lambda x: x["formatted"]), "").alias("formatted")
    )


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    done: list[tuple] = []
    key, started = None, False
    n = loss_chars = chars = 0
    turns, loss = hashlib.sha256(), hashlib.sha256()

    def packed() -> pa.RecordBatch:
        columns = zip(*done, strict=True)
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        done.clear()
        return pa.RecordBatch.from_arrays(arrays, names=names)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_length")]
        for conv_id, text, start, length in zip(*columns, strict=True):
            if not started or conv_id != key:
                if started:
                    done.append((key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                key, started, n, loss_chars, chars = conv_id, True, 0, 0, 0
                turns, loss = hashlib.sha256(), hashlib.sha256()
            ((role, said, _, _),) = parse(text)
            turns.update(f"{role}\n{said}\n".encode())
            masked = unescape(text[start : start + length])
            loss.update(masked.encode())
            n, loss_chars, chars = n + 1, loss_chars + len(masked), chars + len(text)
        if done:
            yield packed()
    if started:
        done.append((key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
        yield packed()


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests per conversation, from the rendered text and the loss spans alone."""
    order = ["conv_id", "turn", "role", "text"]
    return (
        formatted.repartition("conv_id")
        .sortWithinPartitions(*order)
        .select("conv_id", "formatted", "loss_start", "loss_length")
        .mapInArrow(_digest_batches, DIGEST_SCHEMA)
    )


def query(spark, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)],
        "conv_id long, turn long, role string, text string",
    )
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_turns(turns.unionByName(own)))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
d AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
           FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(4 + length(replace(replace(role, '\', '\\'), chr(10), '\n')) + 1 + length(text)
           + (length(text) - length(replace(text, '</turn>', ''))) // 7 + 9) AS chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars,
       sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars
FROM d
"""
