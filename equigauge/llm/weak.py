r"""Quality rules as weak supervision.

Built-in functions only. Every rule looks at one measure of a text and votes good, bad, or
abstains. No rule decides alone: how often a rule is right where it votes is estimated from all
documents by expectation-maximisation, without labels, and a document is kept where the posterior
probability of being good, given its votes, reaches ``POSTERIOR``. A document that fails the base
(too short, or too many repeated windows) is never kept.

Only the rule on odd words votes both ways. The others know one fault each and abstain on a text
without it, since most bad texts have one fault and would else be outvoted by the rules on all
others.

Votes are independent given the class, so estimation needs the number of documents of every vote
pattern only: 3 x 2^9 = 1,536 at most, whatever the number of documents. All rounds are one
expression over the array of these; the driver gets one number a rule and the share of good
documents. Texts are read once, for measures that are written without the text, and documents are
never shuffled.

Repeated windows are found inside a row: hashes of all five-word windows (64 bits), sorted
together with their places only where some are equal.

Defined cases: a null or empty text has no words and fails the base; repeated rows and rows with
one doc_id are judged each for itself; a document without votes has the share of good documents
as its posterior; an empty table gives an empty result; other columns are ignored, except that
``with_quality`` keeps them and refuses those named like its own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equigauge.llm.common import read_table, staged

WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20
POSTERIOR = 0.5
ROUNDS = 40
#: Where estimation starts: the share of good documents, and how often rules are right.
START_GOOD, START_RIGHT = 0.8, 0.8
#: Votes that every rule is thought to have cast beforehand, half of them right.
PRIOR_VOTES = 2.0
#: A rule is never taken to be worse than chance, so a vote is never turned around.
LEAST_RIGHT = 0.5
#: White space that separates words (fixed).
WHITE = " \t\n\x0b\x0c\r"
SHOWN = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
#: What ordinary words do not hold: other signs than punctuation, capitals or marks in a row.
ODD = r"[#*$%&|<>=_~^\\{}\[\]]|\p{Lu}\p{Lu}|[!?]{2}"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FURTHER = ("n_lines", "n_closed_lines", "n_capitals", "n_marks", "n_bare", "n_odd")


@dataclass(frozen=True)
class Rule:
    """Votes bad from the bound ``bad`` of the ratio of two measures on, good up to ``good``.

    Where ``good`` is above ``bad`` it is the other way round. Without ``good`` the rule only
    knows a fault: it votes bad or abstains, for a text without that fault may well have another.
    """

    name: str
    part: str
    whole: str
    bad: float
    good: float | None = None
    falling: bool = False

    def vote(self) -> Column:
        value = F.col(self.part) / F.when(F.col(self.whole) > 0, F.col(self.whole).cast("double"))
        reaches = lambda bound, up: value >= bound if up else value <= bound
        vote = F.when(reaches(self.bad, not self.falling), F.lit(0))
        return vote if self.good is None else vote.when(reaches(self.good, self.falling), F.lit(1))


RULES = (
    Rule("odd_words", "n_odd", "n_words", bad=0.4, good=0.1),
    Rule("repeated_words", "n_repeat_words", "n_words", bad=0.1),
    Rule("symbols", "n_symbols", "n_words", bad=0.1),
    Rule("bare_words", "n_bare", "n_words", bad=0.1),
    Rule("capitals", "n_capitals", "word_chars", bad=0.3),
    Rule("marks", "n_marks", "n_words", bad=0.3),
    Rule("repeated_lines", "n_dup_lines", "n_lines", bad=0.3),
    Rule("open_lines", "n_closed_lines", "n_lines", bad=0.2, falling=True),
    Rule("long_words", "word_chars", "n_words", bad=12),
    Rule("short_words", "word_chars", "n_words", bad=2, falling=True),
)


def measured(docs: DataFrame) -> DataFrame:
    """The measures of every row in place of its text."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    blanks = F.translate(text, WHITE[1:], " " * (len(WHITE) - 1))
    shown = F.filter(F.split(text, "\n"), lambda line: F.rtrim(line, F.lit(WHITE)) != "")
    with_words = docs.withColumns(
        {"_words": F.array_remove(F.split(blanks, " "), ""), "_lines": shown}
    ).withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.translate(text, WHITE, "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_closed_lines": F.size(
                F.filter("_lines", lambda x: F.rtrim(x, F.lit(WHITE)).rlike(r"[.!?:;\"')]\z"))
            ).cast("long"),
            "n_capitals": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"),
            "n_marks": F.regexp_count(text, F.lit("[!?]")).cast("long"),
            # Words without a letter or digit, and words with something odd. Both patterns start at
            # the first character of a word and go over it once, however long it is.
            "n_bare": F.regexp_count(
                text, F.lit(rf"(?<!{SHOWN})[^\p{{L}}\p{{N}}\x20\x09-\x0D]++(?!{SHOWN})")
            ).cast("long"),
            "n_odd": F.regexp_count(text, F.lit(rf"(?<!{SHOWN}){SHOWN}*?(?:{ODD}){SHOWN}*+")).cast("long"),
        }
    )
    return _repeated(with_words).drop("_text", "_words", "_lines")


def _repeated(docs: DataFrame) -> DataFrame:
    """n_repeat_words: words in a window that is found more than once. Needs ``_words``."""
    starts = F.sequence(F.lit(0), F.size("_words") - WINDOW)
    window = lambda i: F.xxhash64(*[F.get("_words", i + j) for j in range(WINDOW)])
    placed = F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    same = lambda k, j: F.get("_sorted", k)["h"] == F.get("_sorted", j)["h"]
    again = lambda k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False))
    # Each place covers the words up to the next place, the window's own at most.
    covered = lambda sum_, k: sum_ + F.least(
        F.lit(WINDOW), F.coalesce(F.get("_places", k + 1) - F.get("_places", k), F.lit(WINDOW))
    )
    none = F.array().cast("array<int>")
    spots = F.filter(F.sequence(F.lit(0), F.size("_sorted") - 1), again)
    return (
        docs.withColumn(
            "_windows",
            F.when(F.size("_words") >= WINDOW, F.transform(starts, window)).otherwise(
                F.array().cast("array<bigint>")
            ),
        )
        .withColumn(
            "_sorted",
            F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(placed)),
        )
        .withColumn(
            "_places",
            F.when(
                F.col("_sorted").isNotNull(),
                F.sort_array(F.transform(spots, lambda k: F.get("_sorted", k)["i"])),
            ).otherwise(none),
        )
        .withColumn(
            "n_repeat_words",
            F.when(
                F.size("_places") > 0,
                F.aggregate(F.sequence(F.lit(0), F.size("_places") - 1), F.lit(0), covered),
            )
            .otherwise(0)
            .cast("long"),
        )
        .drop("_windows", "_sorted", "_places")
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )


def with_votes(measures: DataFrame, rules=RULES) -> DataFrame:
    """Also a column of votes for each rule: 1 good, 0 bad, null no vote."""
    voted = measures.withColumn("one", F.lit(1))
    return voted.withColumns({f"vote_{r.name}": r.vote() for r in rules}).drop("one")


@dataclass(frozen=True)
class Fit:
    """Share of good documents, and how often each rule is right where it votes."""

    good: float
    right: tuple[float, ...]

    def posterior(self, votes: list[str]) -> Column:
        """Probability of being good, from the sum of the log odds of all votes cast."""
        odds = F.lit(math.log(self.good / (1 - self.good)))
        for v, right in zip(votes, self.right, strict=True):
            log_odds = math.log(right / (1 - right))
            odds = odds + F.when(F.col(v) == 1, log_odds).when(F.col(v) == 0, -log_odds).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


# Estimation is one expression over the array of all patterns (n, v), where v has 1, 0 or -1 for
# each rule. Its state is the fit and each pattern's posterior; odd steps renew the latter, even
# steps the former.
_STATE = "STRUCT<good: DOUBLE, r: ARRAY<DOUBLE>, p: ARRAY<DOUBLE>>"
_EXPECT = """transform(patterns, x -> 1 / (1 + exp(-aggregate(
  zip_with(x.v, state.r, (v, r) -> CASE v WHEN 1 THEN ln(r / (1 - r)) WHEN 0 THEN ln((1 - r) / r) ELSE 0D END),
  ln(state.good / (1 - state.good)), (a, b) -> a + b))))"""
_GOOD = f"""(aggregate(zip_with(patterns, state.p, (x, p) -> x.n * p), 0D, (a, b) -> a + b) + {PRIOR_VOTES / 2})
  / (aggregate(patterns, 0D, (a, x) -> a + x.n) + {PRIOR_VOTES})"""
_RIGHTS = f"""transform(state.r, (r, j) -> greatest({LEAST_RIGHT}D, (
  aggregate(zip_with(patterns, state.p, (x, p) ->
    CASE x.v[j] WHEN 1 THEN x.n * p WHEN 0 THEN x.n * (1 - p) ELSE 0D END), 0D, (a, b) -> a + b) + {PRIOR_VOTES / 2})
  / (aggregate(patterns, 0D, (a, x) -> a + IF(x.v[j] >= 0, x.n, 0D)) + {PRIOR_VOTES})))"""


def fit(voted: DataFrame, votes: list[str], rounds: int = ROUNDS) -> Fit:
    """Expectation-maximisation over the numbers of documents of every pattern of votes."""
    pattern = F.array(*[F.coalesce(F.col(v), F.lit(-1)) for v in votes]).alias("v")
    counted = voted.groupBy(pattern).agg(F.count("*").cast("double").alias("n"))
    # In a fixed order, so that sums of doubles come out the same every time.
    gathered = counted.agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("patterns"))
    start = f"named_struct('good', {START_GOOD}D, 'r', array_repeat({START_RIGHT}D, {len(votes)}), 'p', array())"
    step = f"""CASE WHEN i % 2 = 1
      THEN CAST(named_struct('good', state.good, 'r', state.r, 'p', {_EXPECT}) AS {_STATE})
      ELSE CAST(named_struct('good', {_GOOD}, 'r', {_RIGHTS}, 'p', state.p) AS {_STATE}) END"""
    row = gathered.select(
        F.expr(f"aggregate(sequence(1, {2 * rounds}), CAST({start} AS {_STATE}), (state, i) -> {step})").alias("fit")
    ).first()["fit"]
    return Fit(row["good"], tuple(row["r"]))


def judged(measures: DataFrame, rules=RULES) -> DataFrame:
    """Also the votes, base_failed, the posterior, and kept. ``measures`` is read twice."""
    votes = [f"vote_{r.name}" for r in rules]
    voted = with_votes(measures, rules)
    return voted.withColumn("posterior", fit(voted, votes).posterior(votes)).withColumns(
        {
            "base_failed": base_failed(),
            "kept": ~base_failed() & (F.col("posterior") >= POSTERIOR),
        }
    )


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, votes, posterior and verdict of every row."""
    text = docs.select("doc_id", F.col("text").alias("_text"))
    return judged(staged(measured(text), "weak-measures"))


def with_quality(docs: DataFrame, column: str = "posterior") -> DataFrame:
    """All rows and columns of the documents, with their posterior and ``kept``.

    Texts are read twice, for the vote patterns and for the result.
    """
    clash = {column, "kept"} & set(docs.columns)
    if clash:
        raise ValueError(f"the documents have columns named {sorted(clash)}")
    all_ = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").alias("_text"))
    return judged(measured(all_)).select("_row.*", F.col("posterior").alias(column), "kept")


def query(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality_rules(docs).select("doc_id", *BASE, "base_failed", "kept")


def _sql_vote(rule: Rule) -> str:
    value = f"({rule.part} / nullif({rule.whole}, 0)::DOUBLE)"
    up, down = ("<=", ">=") if rule.falling else (">=", "<=")
    good = "" if rule.good is None else f" WHEN {value} {down} {rule.good} THEN 1"
    return f"CASE WHEN {value} {up} {rule.bad} THEN 0{good} END"


_AT = range(1, len(RULES) + 1)
_LIKELY = lambda class_, v, r: " * ".join(
    f"CASE {v}[{j}] WHEN {class_} THEN {r}[{j}] WHEN {1 - class_} THEN 1 - {r}[{j}] ELSE 1 END" for j in _AT
)
_POSTERIOR = (
    f"(good * {_LIKELY(1, 'v', 'r')}) / (good * {_LIKELY(1, 'v', 'r')} + (1 - good) * {_LIKELY(0, 'v', 'r')})"
)
_RIGHT = ", ".join(
    f"greatest({LEAST_RIGHT}, (coalesce(sum(CASE v[{j}] WHEN 1 THEN n * p WHEN 0 THEN n * (1 - p) END), 0)"
    f" + {PRIOR_VOTES / 2}) / (coalesce(sum(CASE WHEN v[{j}] IS NOT NULL THEN n END), 0) + {PRIOR_VOTES}))"
    for j in _AT
)

SQL = rf"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
parts AS (
  SELECT id, doc_id, text, regexp_extract_all(text, '{SHOWN}+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{SHOWN}')) AS lines
  FROM texts),
windows AS (
  SELECT id, i, words[i:i + {WINDOW - 1}] AS win
  FROM parts, unnest(range(1, len(words) - {WINDOW - 2})) AS s(i)),
again AS (SELECT id, i, count(*) OVER (PARTITION BY id, win) AS found FROM windows),
repeats AS (
  SELECT id, count(DISTINCT i + k) AS n_repeat_words
  FROM again, unnest(range({WINDOW})) AS s(k) WHERE found > 1 GROUP BY id),
measures AS (
  SELECT doc_id, len(words) AS n_words,
         coalesce(list_sum([length(w) FOR w IN words]), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '{SYMBOLS}')) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         len(list_filter(lines, lambda x: regexp_matches(
           regexp_replace(x, '[ 	-
]+$', ''), '[.!?:;"'')]$'))) AS n_closed_lines,
         len(regexp_extract_all(text, '\p{{Lu}}')) AS n_capitals,
         len(regexp_extract_all(text, '[!?]')) AS n_marks,
         len(list_filter(words, lambda x: NOT regexp_matches(x, '[\p{{L}}\p{{N}}]'))) AS n_bare,
         len(list_filter(words, lambda x: regexp_matches(x, '{ODD}'))) AS n_odd,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM parts LEFT JOIN repeats USING (id)),
voted AS (SELECT *, [{", ".join(_sql_vote(r) for r in RULES)}] AS v FROM measures),
patterns AS (SELECT v, count(*)::DOUBLE AS n FROM voted GROUP BY v),
em AS (
  SELECT 0 AS i, {START_GOOD}::DOUBLE AS good, [{", ".join([f"{START_RIGHT}::DOUBLE"] * len(RULES))}] AS r
  UNION ALL
  SELECT i + 1, (sum(n * p) + {PRIOR_VOTES / 2}) / (sum(n) + {PRIOR_VOTES}), [{_RIGHT}]
  FROM (SELECT i, v, n, {_POSTERIOR} AS p FROM em, patterns WHERE i < {ROUNDS}) GROUP BY i),
fitted AS (SELECT good, r FROM em WHERE i = {ROUNDS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND p >= {POSTERIOR} AS kept
FROM (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
             {_POSTERIOR} AS p FROM voted, fitted)
"""
