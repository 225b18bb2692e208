r"""Format-preserving pseudonyms of personal data.

Built-in functions only. One pattern finds candidates: e-mail addresses, IPv4 addresses, payment
card numbers, telephone numbers, social security numbers, calendar dates, and quoted secrets after
a name such as ``token =``. Those that are valid (Luhn digit, octets, calendar, number ranges) are
replaced by a keyed permutation of the values of the same format; all other text stays byte by
byte. Equal values get equal pseudonyms in every document, so they stay linked, and two values
never get the same one.

The permutation is a Feistel network of ``ROUNDS`` rounds over two halves, with SHA-256 of key,
format, round and other half as round function. On strings each symbol of a half is shifted inside
its alphabet; on numbers (dates, addresses, social security numbers) the halves are added to
modulo the two factors of the size of the format, so that no value outside it can come out. A
card keeps its first digit and gets the check digit of its new number; a telephone number keeps
its country code; an address keeps its last label; letters keep their case, whereas the case of
letters is no part of a value.

Defined cases: a null text stays null with no values found; texts of any length are searched
whole, with bounded patterns that don't backtrack over long runs; repeated rows give equal rows;
an empty table gives an empty result; other columns, whatever their names, are handed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equigauge.llm.common import read_table

KEY = "pseudonyms-1"
ROUNDS = 8

DIGITS = "0123456789"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
HEX = "0123456789abcdef"

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
SECRET = (
    r"(?<=(?i:token|secret|password|api[_-]?key)[ ]{0,3}[=:][ ]{0,3}[\"'])"
    r"[A-Za-z0-9_/+=.-]{8,}+(?=[\"'])"
)
EMAIL = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@"
    r"[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){0,8}\.[A-Za-z]{2,24}"
)
ADDRESS = rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])"
DATE = (
    r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})"
    r"(?![0-9]|[./-][0-9])"
)
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
PHONE = (
    r"(?<![0-9A-Za-z+])(?:(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}"
    r"|\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,5}|\+[0-9]{8,15}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])"
)
CARD = (
    r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|3[47][0-9]{2}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"
)
ANY = "|".join((SECRET, EMAIL, ADDRESS, DATE, SOCIAL, CARD, PHONE))

#: Dates of the 146,000 days from 1800 on are permuted among themselves, all others of the years 1 to
#: 9999 among themselves. Sizes are factors of the numbers of days; so many are before 1800.
DATE_FROM, DATE_SIZE = "1800-01-01", (365, 400)
EARLIER_DAYS, OTHER_SIZE = 657_071, (47, 74_597)
SOCIAL_SIZE = (898 * 99, 9999)
ADDRESS_SIZE = (65_536, 65_536)


def _digest(parts: list[Column]) -> Column:
    """Keyed digest, 64 hex digits: nested, so that one message can't be extended to another."""
    inner = F.sha2(F.concat(F.lit(KEY + "|"), F.concat_ws("|", *parts)), 256)
    return F.sha2(F.concat(F.lit(KEY + "|"), inner), 256)


def _number(digits: Column, base: int = 10) -> Column:
    return F.conv(digits, base, 10).cast("long")


def _symbols(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def permute_string(text: Column, alphabet: str, form: str) -> Column:
    """``text`` of symbols of ``alphabet`` under the keyed permutation of strings of its length."""
    half = F.floor(F.length(text) / 2).cast("int")

    def shifted(part: Column, other: Column, step: Column) -> Column:
        def shift(symbol: Column, i: Column) -> Column:
            # 16 shifts to a digest, four hex digits for each.
            block = F.floor(i / 16).cast("string")
            stream = _digest([F.lit(form), step.cast("string"), block, F.length(text).cast("string"), other])
            drawn = _number(F.substring(stream, (i % 16) * 4 + 1, F.lit(4)), 16)
            at = (F.position(symbol, F.lit(alphabet)) - 1 + drawn) % len(alphabet)
            return F.substring(F.lit(alphabet), at.cast("int") + 1, F.lit(1))

        return F.array_join(F.transform(_symbols(part), shift), "")

    def turn(state: Column, step: Column) -> Column:
        return F.struct(
            state["b"].alias("a"), shifted(state["a"], state["b"], step).alias("b")
        )

    start = F.struct(
        F.substring(text, F.lit(1), half).alias("a"),
        F.substring(text, half + 1, F.length(text)).alias("b"),
    )
    steps = F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(steps, start, turn, lambda s: F.concat(s["a"], s["b"]))


def permute_pair(a: Column, b: Column, size: tuple[int, int], form: str) -> tuple[Column, Column]:
    """(a, b), with a below size[0] and b below size[1], under a keyed permutation of such pairs."""

    def turn(state: Column, step: Column) -> Column:
        def drawn(other: Column) -> Column:
            digest = _digest([F.lit(form), step.cast("string"), other.cast("string")])
            return _number(F.substring(digest, 1, 15), 16)

        odd = step % 2 == 1
        return F.struct(
            F.when(odd, (state["a"] + drawn(state["b"])) % size[0]).otherwise(state["a"]).alias("a"),
            F.when(odd, state["b"]).otherwise((state["b"] + drawn(state["a"])) % size[1]).alias("b"),
        )

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)
    return done["a"], done["b"]


def put_back(value: Column, digits: Column, letters: Column) -> Column:
    """``value`` with its digits and letters replaced in order; letters keep their case."""

    def step(state: Column, c: Column) -> Column:
        digit, small, large = (F.regexp_like(c, F.lit(p)) for p in ("[0-9]", "[a-z]", "[A-Z]"))
        letter = F.substring(letters, state["l"] + 1, F.lit(1))
        symbol = (
            F.when(digit, F.substring(digits, state["d"] + 1, F.lit(1)))
            .when(small, letter)
            .when(large, F.upper(letter))
            .otherwise(c)
        )
        return F.struct(
            F.concat(state["out"], symbol).alias("out"),
            F.when(digit, state["d"] + 1).otherwise(state["d"]).alias("d"),
            F.when(small | large, state["l"] + 1).otherwise(state["l"]).alias("l"),
        )

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("d"), F.lit(0).alias("l"))
    return F.aggregate(_symbols(value), start, step, lambda s: s["out"])


def _only(value: Column, symbols: str) -> Column:
    return F.regexp_replace(value, f"[^{symbols}]", "")


def luhn_sum(digits: Column, last_counts_double: bool) -> Column:
    """Luhn sum of a string of digits; whether the last digit is one of those that double."""
    odd = int(last_counts_double)

    def add(total: Column, pair: Column) -> Column:
        value = pair["c"].cast("int") * F.when((pair["i"] + odd) % 2 == 1, 2).otherwise(1)
        return total + F.when(value > 9, value - 9).otherwise(value)

    pairs = F.transform(
        _symbols(F.reverse(digits)), lambda c, i: F.struct(c.alias("c"), i.alias("i"))
    )
    return F.aggregate(pairs, F.lit(0), add)


def card(value: Column) -> Column:
    digits = _only(value, "0-9")
    n = F.length(digits)
    body = F.concat(
        F.substring(digits, 1, 1), permute_string(F.substring(digits, F.lit(2), n - 2), DIGITS, "card")
    )
    check = ((10 - luhn_sum(body, True) % 10) % 10).cast("string")
    return F.when(
        luhn_sum(digits, False) % 10 == 0, put_back(value, F.concat(body, check), F.lit(""))
    ).otherwise(value)


def phone(value: Column) -> Column:
    code = F.when(F.regexp_like(value, F.lit(r"^\+[0-9]{1,3}[ .(-]")), F.regexp_extract(value, r"^\+([0-9]{1,3})", 1)).otherwise("")
    digits = _only(value, "0-9")
    rest = F.substring(digits, F.length(code) + 1, F.length(digits))
    return put_back(value, F.concat(code, permute_string(rest, DIGITS, "phone")), F.lit(""))


def email(value: Column) -> Column:
    last = F.regexp_extract(value, r"(\.[A-Za-z]+)$", 1)
    name = F.substring(value, F.lit(1), F.length(value) - F.length(last))
    small = F.lower(name)
    digits = permute_string(_only(small, "0-9"), DIGITS, "email-digits")
    letters = permute_string(_only(small, "a-z"), LETTERS, "email-letters")
    return F.concat(put_back(name, digits, letters), last)


def secret(value: Column) -> Column:
    small = F.lower(value)
    hexed = permute_string(small, HEX, "hex")
    as_hex = F.when(value == small, hexed).otherwise(F.upper(hexed))
    digits = permute_string(_only(small, "0-9"), DIGITS, "secret-digits")
    letters = permute_string(_only(small, "a-z"), LETTERS, "secret-letters")
    one_case = F.regexp_like(value, F.lit(r"^(?:[0-9a-f]+|[0-9A-F]+)$"))
    return F.when(one_case, as_hex).otherwise(put_back(value, digits, letters))


def address(value: Column) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda x: x.cast("int"))
    a, b = permute_pair(
        parts[0] * 256 + parts[1], parts[2] * 256 + parts[3], ADDRESS_SIZE, "ipv4"
    )
    octets = [F.floor(a / 256), a % 256, F.floor(b / 256), b % 256]
    return F.concat_ws(".", *[o.cast("string") for o in octets])


def social(value: Column) -> Column:
    area, group, serial = (
        F.substring(value, at, n).cast("int") for at, n in ((1, 3), (5, 2), (8, 4))
    )
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    a, b = permute_pair(place * 99 + group - 1, serial - 1, SOCIAL_SIZE, "social")
    place = F.floor(a / 99)
    new_area = F.when(place >= 665, place + 2).otherwise(place + 1)
    texts = ((new_area, 3), (a % 99 + 1, 2), (b + 1, 4))
    written = F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in texts])
    return F.when(valid, written).otherwise(value)


def date(value: Column) -> Column:
    out = value
    first, days = F.lit(DATE_FROM).cast("date"), DATE_SIZE[0] * DATE_SIZE[1]
    for form, shape in (
        ("MM/dd/yyyy", "/"), ("dd/MM/yyyy", "/"), ("dd.MM.yyyy", r"\."), ("yyyy-MM-dd", "[0-9]-"),
    ):
        day = F.try_to_date(value, form)
        n = F.datediff(day, first)
        a, b = permute_pair(F.floor(n / DATE_SIZE[1]), n % DATE_SIZE[1], DATE_SIZE, f"date-{form}")
        # The other days are numbered without the gap between them.
        other = F.when(n < 0, n + EARLIER_DAYS).otherwise(n - days + EARLIER_DAYS)
        c, d = permute_pair(
            F.floor(other / OTHER_SIZE[1]), other % OTHER_SIZE[1], OTHER_SIZE, f"other-date-{form}"
        )
        new_other = c * OTHER_SIZE[1] + d - EARLIER_DAYS
        new = F.when(n.between(0, days - 1), a * DATE_SIZE[1] + b).otherwise(
            F.when(new_other < 0, new_other).otherwise(new_other + days)
        )
        written = F.date_format(F.date_add(first, new.cast("int")), form)
        out = F.when(F.regexp_like(value, F.lit(shape)) & n.isNotNull(), written).otherwise(out)
    return out


def pseudonym(value: Column) -> Column:
    """A candidate found by ``ANY``, replaced if it is valid."""

    def is_a(pattern: str) -> Column:
        # The look-around parts hold where the candidate was found.
        return F.regexp_like(value, F.lit(f"^(?:{pattern})$"))

    bare = {
        "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}",
        "social": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        "card": r"[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|3[47][0-9]{2}[ -][0-9]{6}[ -][0-9]{5}",
        "phone": r"[+(0-9][0-9 .()+-]+",
    }
    return (
        F.when(is_a(EMAIL), email(value))
        .when(is_a(ADDRESS), address(value))
        .when(is_a(bare["date"]), date(value))
        .when(is_a(bare["social"]), social(value))
        .when(is_a(bare["card"]), card(value))
        .when(is_a(bare["phone"]) & F.regexp_like(value, F.lit(r"[ .()+-]")), phone(value))
        .otherwise(secret(value))
    )


def pseudonymise(docs: DataFrame, text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with the personal data of ``text`` replaced; ``count`` names a column for how many.

    The text is cut at the candidates and put together again with their pseudonyms.
    """
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in names]).alias("row"))
    found = packed.withColumn(
        "found",
        F.when(
            F.regexp_like(F.col(f"row.`{text}`"), F.lit("[0-9@\"']")),
            F.regexp_extract_all(F.col(f"row.`{text}`"), F.lit(ANY), 0),
        ),
    )
    some = F.size("found") > 0
    new = found.withColumn("new", F.when(some, F.transform("found", pseudonym)))
    between = F.split(F.col(f"row.`{text}`"), ANY, -1)
    joined = F.array_join(
        F.transform(between, lambda part, i: F.concat(part, F.coalesce(F.get("new", i), F.lit("")))), ""
    )
    out = [
        (F.when(some, joined).otherwise(F.col(f"row.`{c}`")) if c == text else F.col(f"row.`{c}`")).alias(c)
        for c in names
    ]
    if count:
        changed = F.size(F.filter(F.arrays_zip("found", "new"), lambda x: x["found"] != x["new"]))
        out.append(F.when(some, changed).otherwise(0).cast("int").alias(count))
    return new.select(*out)


def query(spark, sf_dir: str) -> DataFrame:
    """doc_id, the new text of every document, and how many values were replaced in it."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, count="n_replaced")
