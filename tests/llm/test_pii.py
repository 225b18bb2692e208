import datetime
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from equigauge.llm import pii
from equigauge.llm.pii import pseudonymise


def luhn(number):
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def digest(*parts):
    inner = hashlib.sha256(f"{pii.KEY}|{'|'.join(parts)}".encode()).hexdigest()
    return hashlib.sha256(f"{pii.KEY}|{inner}".encode()).hexdigest()


def permuted(text, alphabet, form):
    """The Feistel network over a string, step by step."""
    n, half = len(text), len(text) // 2
    a, b = text[:half], text[half:]
    for step in range(1, pii.ROUNDS + 1):
        out = ""
        for i, c in enumerate(a):
            stream = digest(form, str(step), str(i // 16), str(n), b)
            drawn = int(stream[i % 16 * 4 : i % 16 * 4 + 4], 16)
            out += alphabet[(alphabet.index(c) + drawn) % len(alphabet)]
        a, b = b, out
    return a + b


def replaced(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r["text"] for r in pseudonymise(df).orderBy("doc_id").collect()]


def test_values_keep_their_format_and_stay_linked(spark):
    card, phone, mail = "4111111111111111", "+1 (555) 123-4567", "Ann.B-7@Mail3.example.com"
    one, two = replaced(spark, f"a {card}, {phone} {mail}! 10.20.30.255", f"{mail.upper()}\n{card[:4]} {card[4:8]} {card[8:12]} {card[12:]} {phone}")
    new = re.match(r"^a (\d{16}), (\+1 \(\d{3}\) \d{3}-\d{4}) ([A-Z][a-z]{2}\.[A-Z]-\d@[A-Z][a-z]{3}\d\.[a-z]{7}\.com)! (\d+\.\d+\.\d+\.\d+)$", one)
    assert new and luhn(new[1]) and new[1][0] == "4" and new[1] != card and new[2] != phone
    assert all(0 <= int(x) <= 255 for x in new[4].split("."))
    again = two.split("\n")
    assert again[0].lower() == new[3].lower() and again[1].replace(" ", "")[:16] == new[1] and again[1].endswith(new[2])


def test_only_valid_values_change(spark):
    same = ["4111111111111112", "9111111111111111 1234", "999.1.1.1 and 1.2.3.4.5 and 4.0.", "1980-02-30 31.04.2001",
            "000-12-3456 666-12-3456", "x@y ab@c", "", None, "token = unquoted0123456789", "v1.2.3", "x" * 200_000, "1" * 5000]
    assert replaced(spark, *same) == same


def test_dates_and_numbers_stay_in_range(spark):
    texts = ["1999-12-31", "31/12/1999", "12/31/1999", "31.12.1999", "123-45-6789"]
    got = replaced(spark, *texts)
    assert datetime.date.fromisoformat(got[0]) and datetime.datetime.strptime(got[1], "%d/%m/%Y")
    assert datetime.datetime.strptime(got[2], "%m/%d/%Y") and datetime.datetime.strptime(got[3], "%d.%m.%Y")
    assert re.match(r"^(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}$", got[4]) and all(a != b for a, b in zip(got, texts, strict=True))


def test_secrets(spark):
    key = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"
    upper, lower = replaced(spark, f'TOKEN = "{key}"!!', f"token: '{key.lower()}' x")
    found = re.match(r'^TOKEN = "([0-9A-F]{40})"!!$', upper)[1]
    assert found != key and lower == f"token: '{found.lower()}' x"


def test_permutations_against_a_plain_version(spark):
    texts = ["0", "12", "123", "99999999999999999999999999999999999999", "0" * 33]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(pii.permute_string(F.col("t"), pii.DIGITS, "f")).collect()]
    assert got == [permuted(t, pii.DIGITS, "f") for t in texts]


def test_permutations_are_one_to_one(spark):
    strings = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("t"))
    got = {r[0] for r in strings.select(pii.permute_string(F.col("t"), pii.DIGITS, "f")).collect()}
    assert got == {f"{i:03d}" for i in range(1000)}
    pairs = spark.range(35 * 11).select((F.col("id") / 11).cast("long").alias("a"), (F.col("id") % 11).alias("b"))
    a, b = pii.permute_pair(F.col("a"), F.col("b"), (35, 11), "p")
    assert {tuple(r) for r in pairs.select(a, b).collect()} == {(i, j) for i in range(35) for j in range(11)}


def test_rows_and_columns_are_kept(documents):
    docs = documents([(1, "4111111111111111 and 4111111111111112", "s"), (1, None, None), (None, "10.0.0.1", "s")])
    got = pseudonymise(docs, count="n_replaced")
    assert got.columns == [*docs.columns, "n_replaced"]
    assert sorted(r["n_replaced"] for r in got.collect()) == [0, 1, 1]
    assert pseudonymise(documents([])).count() == 0
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("size", [pii.DATE_SIZE, pii.SOCIAL_SIZE, pii.ADDRESS_SIZE])
def test_formats_fit_their_numbers(size):
    assert size[0] * size[1] in {146_000, 898 * 99 * 9999, 1 << 32}


def test_every_luhn_number_is_replaced(spark):
    """Whatever its first digit and its length; numbers that fail the check stay."""
    numbers = []
    for first in "0123456789":
        for size in (13, 16, 19):
            body = first + "27182818284590452353"[: size - 2]
            numbers += [body + c for c in "0123456789" if luhn(body + c)]
    assert len(numbers) == 30
    out = replaced(spark, *numbers)
    assert all(luhn(n) and len(n) == len(o) and n[0] == o[0] for n, o in zip(numbers, out, strict=True))
    assert sum(n != o for n, o in zip(numbers, out, strict=True)) >= 29
    bad = [n[:-1] + str((int(n[-1]) + 1) % 10) for n in numbers]
    assert replaced(spark, *bad) == bad


def test_dates_of_any_year(spark):
    days = [datetime.date(y, m, d) for y in (1, 999, 1799, 1800, 2199, 2200, 9999) for m, d in ((1, 1), (12, 31), (2, 28))]
    out = replaced(spark, *[d.isoformat() for d in days])
    new = [datetime.date.fromisoformat(o) for o in out]
    assert all(re.fullmatch(r"\d{4}-\d\d-\d\d", o) for o in out)
    assert len(set(new)) == len(days) and sum(a != b for a, b in zip(days, new, strict=True)) >= len(days) - 1
    # Common dates stay among themselves.
    first, last = datetime.date(1800, 1, 1), datetime.date(1800, 1, 1) + datetime.timedelta(365 * 400 - 1)
    assert [first <= a <= last for a in days] == [first <= b <= last for b in new]


def test_other_dates_are_permuted_one_to_one(spark):
    every = spark.sql("SELECT explode(sequence(DATE'2200-01-01', DATE'2212-12-31', INTERVAL 1 DAY)) AS d").select(
        F.date_format("d", "dd.MM.yyyy").alias("text"))
    new = every.select(pii.date(F.col("text")).alias("x"))
    assert new.distinct().count() == every.count()


def test_long_secrets(spark):
    secret = "aB3_" * 75
    (out,) = replaced(spark, f"token = '{secret}' and {secret}")
    found = re.fullmatch(r"token = '([A-Za-z0-9_]{300})' and (.*)", out)
    assert found and found[1] != secret and found[2] == secret
