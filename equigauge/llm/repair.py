r"""Conversation structure repair over a suffix-shared automaton.

A conversation is legal where the initials of its roles read ``(s?(ua)+)?``. Its rows become a
signature, one symbol a row: the role's class (``s``, ``u``, ``a``, ``o`` for any other), a
capital where the row is truncated, ``x`` where it must go. Every suffix of every signature is a
node of one acyclic automaton, minimised from the end: equal suffixes are one node, in whatever
conversations they occur. A node is left by one symbol to the node of the suffix after it, so a
node and a grammar state have one cheapest way to the end, which is found once and holds for all
conversations that share the node. What is kept of the best audit suffix is its edits up to the
node's own row and the state after it; the rest is the next node's.

Distinct signatures are range partitioned and sorted by their reverse. Neighbours in that order
share the longest suffixes, so a task walks the nodes of its range depth first and holds one path
of them; only the nodes of the path at a range's start are made by two tasks. Ties are settled
without comparing audits: the choices of a node and state begin with different edits, so the least
initial among the cheapest begins the least audit.

Two shuffles of rows: one of narrow rows without texts (signatures), one of whole rows (repaired
turns). A conversation streams through one task in order; what is held of it is its signature or
audit, a character a row. Plans are joined to conversations by signature; signatures of many
conversations are salted.

Edits and costs: Keep 0, Rerole to user or assistant 3, Delete 4, Insert an empty user or
assistant turn 3, and 3 more for a truncated row that is not deleted. Blank and duplicate rows
must be deleted.

Defined cases: null role, text, conv_id or turn read as one space where they are hashed or written;
rows sort by turn (null first), then role, then MD5 of the text; repeated rows are duplicates; a
null conv_id is one conversation; an empty role has no initial and can't be kept; a conversation
without rows has cost 0 and an empty audit; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equigauge.llm.common import read_table, staged

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: White space of a text (fixed): a row of nothing else is blank.
WHITE = " \t\n\x0b\x0c\r"
#: A signature of at least one in so many conversations is salted; so many may be listed, no more.
HOT = 512
SALTS = 64
#: Rows and characters of a batch that goes back to Spark.
BATCH_ROWS, BATCH_CHARS = 2048, 8 << 20

SIGNED = (
    "conv_id long, signature string, gaps long, blank long, duplicate long, truncated long, illegal long"
)
PLANS = "signature string, conversations long, cost long, audit string"
REPAIRED = "conv_id long, place long, role string, text string, edit string"

# Grammar states: nothing written, a system turn written, an assistant due, a user due or the end.
START, AFTER_SYSTEM, AFTER_USER, AFTER_PAIR = range(4)
_INSERTED = (AFTER_USER, AFTER_USER, AFTER_PAIR, AFTER_USER)
_KEPT = {
    ("s", START): AFTER_SYSTEM,
    ("u", START): AFTER_USER,
    ("u", AFTER_SYSTEM): AFTER_USER,
    ("u", AFTER_PAIR): AFTER_USER,
    ("a", AFTER_USER): AFTER_PAIR,
}
_ROLE = ("user", "user", "assistant", "user")
#: A node: for each state the cost to the end, the edits up to its row's own, the state after it.
Node = tuple[tuple[int, str, int], ...]
#: Behind the last row an open pair is completed by inserted turns.
END: Node = ((0, "", START), (2 * INSERT, "II", AFTER_PAIR), (INSERT, "I", AFTER_PAIR), (0, "", AFTER_PAIR))


def node_before(symbol: str, rest: Node) -> Node:
    """The node that a symbol leads from, given the node that it leads to."""
    own = []
    for state in range(4):
        ways = [(DELETE + rest[state][0], "D", state)]
        if symbol != "x":
            extra = TRUNCATED if symbol.isupper() else 0
            kept = _KEPT.get((symbol.lower(), state))
            if kept is not None:
                ways.append((KEEP + extra + rest[kept][0], "K", kept))
            written = _INSERTED[state]
            ways.append((REROLE + extra + rest[written][0], "R", written))
        own.append(min(ways))
    # Insertions stay at the node. Two in a row come back to the state, so one after the other is
    # enough to look at, a user and an assistant behind the start.
    once = [min(own[q], _after_insert(own[_INSERTED[q]])) for q in range(4)]
    return tuple(min(own[q], _after_insert(once[_INSERTED[q]])) for q in range(4))


def _after_insert(way: tuple[int, str, int]) -> tuple[int, str, int]:
    return INSERT + way[0], "I" + way[1], way[2]


def walk(reversed_signatures: Iterable[str]) -> Iterator[tuple[str, int, str]]:
    """signature, cost and audit of sorted reversed signatures; a shared suffix is built once."""
    path, before = [END], ""
    for signature in reversed_signatures:
        shared, most = 0, min(len(before), len(signature))
        while shared < most and before[shared] == signature[shared]:
            shared += 1
        del path[shared + 1 :]
        for symbol in signature[shared:]:
            path.append(node_before(symbol, path[-1]))
        state, edits = START, []
        for node in reversed(path):
            _, step, state = node[state]
            edits.append(step)
        yield signature[::-1], path[-1][START][0], "".join(edits)
        before = signature


def damaged(turns: DataFrame) -> DataFrame:
    """The rows of the test bed: a hash of conversation and turn drops, empties, cuts, repeats or
    reroles a row. Dropped rows stay, marked ``lost``, so that their conversation is not forgotten.
    """
    space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fate = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))), F.lit(20))
    text = space("text")
    return (
        turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
        .withColumn("_fate", fate)
        .select(
            "conv_id",
            "turn",
            F.when(F.col("_fate") == 4, F.lit("user")).otherwise(space("role")).alias("role"),
            F.when(F.col("_fate") == 1, F.lit(""))
            .when(F.col("_fate") == 2, F.translate(text, ".!?", ""))
            .otherwise(text)
            .alias("text"),
            (F.col("_fate") == 0).alias("lost"),
            F.explode(F.array_repeat(F.lit(1), F.when(F.col("_fate") == 3, 2).otherwise(1))).alias("_copy"),
        )
        .drop("_copy")
    )


def _prepared(turns: DataFrame) -> DataFrame:
    """Rows without nulls in role and text, with the key that orders and tells texts apart."""
    lost = F.col("lost") if "lost" in turns.columns else F.lit(False)
    space = lambda name: F.coalesce(F.col(name), F.lit(" "))
    return turns.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        space("role").alias("role"),
        space("text").alias("text"),
        lost.alias("lost"),
    ).withColumn("_text", F.unhex(F.md5("text")))


def signed(turns: DataFrame) -> DataFrame:
    """One row per conversation: signature and counts of its faults."""
    shown = F.rtrim(F.col("text"), F.lit(WHITE))
    role = F.substring("role", 1, 1)
    narrow = _prepared(turns).select(
        "conv_id",
        "turn",
        "role",
        "lost",
        "_text",
        F.when(role.isin("s", "u", "a"), role).otherwise(F.lit("o")).alias("letter"),
        F.when(shown == "", F.lit("b"))
        .when(~F.substring(shown, -1, 1).isin(".", "!", "?"), F.lit("t"))
        .otherwise(F.lit(""))
        .alias("fault"),
    )
    # The first of equal rows is no duplicate. Rows are dealt by conversation for both sorts.
    same = Window.partitionBy("conv_id", "lost", "role", "_text").orderBy(F.col("turn").asc_nulls_first())
    told = narrow.repartition("conv_id").withColumn("_seen", F.row_number().over(same) > 1)
    told = told.withColumn(
        "fault",
        F.when(F.col("lost"), F.lit("-"))
        .when(F.col("_seen") & (F.col("fault") != "b"), F.lit("d"))
        .otherwise(F.col("fault")),
    ).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "_text", "_seen")
    return told.select("conv_id", "turn", "letter", "fault").mapInArrow(_sign, SIGNED)


_LEGAL = {"su", "ua", "au"}


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    key, started = None, False
    symbols: list[str] = []
    counts = {"b": 0, "d": 0, "t": 0, "illegal": 0}
    low = high = last_turn = None
    turns, last_letter = 0, ""

    def closed() -> tuple:
        gaps = high - low + 1 - turns if turns else 0
        return key, "".join(symbols), gaps, counts["b"], counts["d"], counts["t"], counts["illegal"]

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "letter", "fault")]
        for conv_id, turn, letter, fault in zip(*columns, strict=True):
            if not started or conv_id != key:
                if started:
                    rows.append(closed())
                key, started, symbols, last_letter = conv_id, True, [], ""
                counts = dict.fromkeys(counts, 0)
                low = high = last_turn = None
                turns = 0
            if fault == "-":
                continue
            if turn is not None and turn != last_turn:
                low = turn if low is None else low
                high = last_turn = turn
                turns += 1
            if last_letter and last_letter + letter not in _LEGAL:
                counts["illegal"] += 1
            last_letter = letter
            if fault:
                counts[fault] += 1
            symbols.append("x" if fault in ("b", "d") else letter.upper() if fault == "t" else letter)
        if rows:
            yield _packed(rows, SIGNED)
    if started:
        rows.append(closed())
        yield _packed(rows, SIGNED)


def _packed(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """The rows as a batch; the list is emptied."""
    names, kinds = zip(*(field.split() for field in schema.split(", ")), strict=True)
    types = [{"long": pa.int64(), "string": pa.string()}[k] for k in kinds]
    arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
    rows.clear()
    return pa.RecordBatch.from_arrays(arrays, names=list(names))


def plans(signatures: DataFrame) -> DataFrame:
    """Cheapest repair of every distinct signature, with the number of conversations that have it."""
    counted = signatures.groupBy("signature").agg(F.count("*").alias("conversations"))
    return (
        counted.select(F.reverse("signature").alias("_back"), "conversations")
        .repartitionByRange("_back")
        .sortWithinPartitions("_back")
        .mapInArrow(_plan, PLANS)
    )


def _plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: list[int] = []

    def backwards() -> Iterator[str]:
        for batch in batches:
            pairs = zip(batch.column("_back").to_pylist(), batch.column("conversations").to_pylist(), strict=True)
            for signature, n in pairs:
                counts.append(n)
                yield signature

    rows, chars = [], 0
    for signature, cost, audit in walk(backwards()):
        rows.append((signature, counts.pop(), cost, audit))
        chars += len(signature) + len(audit)
        if len(rows) >= BATCH_ROWS or chars >= BATCH_CHARS:
            yield _packed(rows, PLANS)
            chars = 0
    if rows:
        yield _packed(rows, PLANS)


def audits(turns: DataFrame) -> DataFrame:
    """One row per conversation: its faults, the cheapest cost and the audit that comes first."""
    conversations = staged(signed(turns), "repair-signed")
    planned = staged(plans(conversations), "repair-plans")
    # At most HOT signatures can each have one in HOT of all conversations, so this list is short.
    many = planned.agg(F.sum("conversations").alias("n")).first()["n"] or 0
    hot = planned.filter(F.col("conversations") * HOT >= F.lit(many)).select(
        F.xxhash64("signature").alias("_hash"), F.lit(SALTS).alias("_salts")
    ).distinct()

    def salted(df: DataFrame, salts) -> DataFrame:
        known = df.withColumn("_hash", F.xxhash64("signature")).join(F.broadcast(hot), "_hash", "left")
        return known.withColumn("_salt", salts(F.coalesce("_salts", F.lit(1)))).drop("_hash", "_salts")

    left = salted(conversations, lambda n: F.pmod(F.xxhash64("conv_id"), n).cast("int"))
    right = salted(planned, lambda n: F.explode(F.sequence(F.lit(0), n - 1))).drop("conversations")
    return left.join(right, ["signature", "_salt"]).drop("_salt")


def repaired_turns(turns: DataFrame, audited: DataFrame) -> DataFrame:
    """The turns of the repaired conversations, in order within each partition.

    place counts from 0; edit is K, R or I.
    """
    rows = _prepared(turns).filter(~F.col("lost")).select(
        "conv_id", F.lit(1).alias("_kind"), "turn", "role", "_text", "text"
    )
    heads = audited.select(
        "conv_id",
        F.lit(0).alias("_kind"),
        F.lit(None).cast("long").alias("turn"),
        F.lit("").alias("role"),
        F.lit(None).cast("binary").alias("_text"),
        F.col("audit").alias("text"),
    )
    both = rows.unionByName(heads).repartition("conv_id").sortWithinPartitions(
        "conv_id", "_kind", F.col("turn").asc_nulls_first(), "role", "_text"
    )
    return both.select("conv_id", "_kind", "role", "text").mapInArrow(_apply, REPAIRED)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    chars = 0
    audit, at, place, state, conv_id = "", 0, 0, START, None

    def write(role: str, text: str, edit: str) -> None:
        nonlocal place, chars
        rows.append((conv_id, place, role, text, edit))
        place, chars = place + 1, chars + len(text)

    def insert() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            write(_ROLE[state], "", "I")
            at, state = at + 1, _INSERTED[state]

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "_kind", "role", "text")]
        for key, kind, role, text in zip(*columns, strict=True):
            if kind == 0:
                insert()
                audit, at, place, state, conv_id = text, 0, 0, START, key
            else:
                insert()
                edit = audit[at]
                at += 1
                if edit == "K":
                    write(role, text, "K")
                    state = _KEPT[role[0], state]
                elif edit == "R":
                    write(_ROLE[state], text, "R")
                    state = _INSERTED[state]
            if len(rows) >= BATCH_ROWS or chars >= BATCH_CHARS:
                yield _packed(rows, REPAIRED)
                chars = 0
    insert()
    if rows:
        yield _packed(rows, REPAIRED)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    key, digest = None, None
    schema = "conv_id long, repaired_sha256 string"
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text")]
        for conv_id, place, role, text in zip(*columns, strict=True):
            if place == 0:
                if digest is not None:
                    rows.append((key, digest.hexdigest()))
                key, digest = conv_id, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        if rows:
            yield _packed(rows, schema)
    if digest is not None:
        rows.append((key, digest.hexdigest()))
        yield _packed(rows, schema)


def repair_digests(turns: DataFrame) -> DataFrame:
    """Faults, cost and audit per conversation, with the digest of its repaired turns."""
    audited = staged(audits(turns), "repair-audits")
    # Turns of a conversation come in order from one task and are digested there.
    digests = repaired_turns(turns, audited).mapInArrow(_digest, "conv_id long, repaired_sha256 string")
    mine, theirs = audited.alias("a"), digests.alias("d")
    return mine.join(theirs, F.col("a.conv_id").eqNullSafe(F.col("d.conv_id")), "left").select(
        "a.conv_id",
        *["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"],
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return repair_digests(damaged(read_table(spark, sf_dir, "conversations")))


def _ways(state: str, kept: dict[str, str], written: str) -> str:
    """The cheapest way of one state over row ``r``, as SQL over the states ``st`` behind the row."""
    rest = "CASE r.initial " + " ".join(f"WHEN '{x}' THEN st.{q}" for x, q in kept.items()) + " END"
    role = _ROLE["psua".index(state)]
    return f"""list_sort([
      {{'c': st.{state}.c + 4, 'e': 'D' || st.{state}.e, 'l': st.{state}.l}},
      {{'c': coalesce(({rest}).c, 1000000) + r.extra, 'e': 'K' || ({rest}).e,
        'l': chr(10) || r.role || ':' || r.text || ({rest}).l}},
      {{'c': st.{written}.c + 3 + r.extra, 'e': 'R' || st.{written}.e,
        'l': chr(10) || '{role}:' || r.text || st.{written}.l}}])[1]"""


def _insertion(state: str, written: str) -> str:
    role = _ROLE["psua".index(state)]
    return f"""list_sort([st.{state}, {{'c': st.{written}.c + 3, 'e': 'I' || st.{written}.e,
      'l': chr(10) || '{role}:' || st.{written}.l}}])[1]"""


#: States: p before anything, s after a system turn, u an assistant is due, a a pair is whole. Each
#: holds cost, audit and lines of its cheapest way to the end; ways compare by cost, then by audit.
#: Every row is one step over the row and two steps that may insert a turn before it.
SQL = f"""
WITH keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_reduce([ord(c)::BIGINT FOR c IN string_split(
             coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')],
           lambda crc, byte: list_reduce(range(8),
             lambda x, bit: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, byte)),
           4294967295::BIGINT) AS crc
  FROM conversations),
fated AS (SELECT *, xor(crc, 4294967295) % 20 AS fate FROM keyed),
kept AS (
  SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM fated, unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copies(i)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS pos
  FROM kept),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS seen,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown
  FROM ranked),
faulty AS (
  SELECT *, CASE WHEN shown = '' THEN 'b' WHEN seen > 1 THEN 'd'
                 WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
         left(role, 1) AS initial,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before
  FROM placed),
grouped AS (
  SELECT conv_id,
         CASE WHEN count(turn) = 0 THEN 0
              ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
         count(*) FILTER (WHERE fault = 'b') AS blank,
         count(*) FILTER (WHERE fault = 'd') AS duplicate,
         count(*) FILTER (WHERE fault = 't') AS truncated,
         count(*) FILTER (WHERE pos > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id),
steps AS (
  SELECT conv_id, list({{'initial': CASE WHEN step > 0 THEN '+' ELSE initial END, 'role': role, 'text': text,
           'extra': CASE fault WHEN 't' THEN 3 WHEN '' THEN 0 ELSE 1000000 END}} ORDER BY pos DESC, step) AS back
  FROM faulty, unnest(range(3)) AS s(step) GROUP BY conv_id),
solved AS (
  SELECT conv_id, list_reduce(back, lambda st, r: CASE WHEN r.initial = '+' THEN {{
      'p': {_insertion("p", "u")}, 's': {_insertion("s", "u")},
      'u': {_insertion("u", "a")}, 'a': {_insertion("a", "u")}}}
    ELSE {{
      'p': {_ways("p", {"s": "s", "u": "u"}, "u")}, 's': {_ways("s", {"u": "u"}, "u")},
      'u': {_ways("u", {"a": "a"}, "a")}, 'a': {_ways("a", {"u": "u"}, "u")}}} END,
    {{'p': {{'c': 0::BIGINT, 'e': '', 'l': ''}},
      's': {{'c': 6::BIGINT, 'e': 'II', 'l': chr(10) || 'user:' || chr(10) || 'assistant:'}},
      'u': {{'c': 3::BIGINT, 'e': 'I', 'l': chr(10) || 'assistant:'}},
      'a': {{'c': 0::BIGINT, 'e': '', 'l': ''}}}}).p AS best
  FROM steps)
SELECT every.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
       coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.e, '') AS audit,
       sha256(coalesce(substr(best.l, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS every
LEFT JOIN grouped ON grouped.conv_id IS NOT DISTINCT FROM every.conv_id
LEFT JOIN solved ON solved.conv_id IS NOT DISTINCT FROM every.conv_id
"""
