"""Text cleaning and lenient parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

# Characters counted as white space (fixed values: the Unicode white-space set).
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(col: Column) -> Column:
    """Text without white space at either end (``trim`` alone drops only blanks)."""
    return F.btrim(col.cast("string"), F.lit(WHITE_SPACE))


def clean_upper(col: Column) -> Column:
    return strip(F.upper(col.cast("string")))


def zero_pad(col: Column, width: int) -> Column:
    """Left-pad with zeros; longer text keeps its full length."""
    text = strip(col)
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def nan_to_null(col: Column) -> Column:
    """A typed number as double with NaN read as missing."""
    return F.nullif(col.try_cast("double"), F.lit(float("nan")))


def lenient_double(col: Column) -> Column:
    """A number, or null when the text is not one. NaN and infinity also become null."""
    text = F.rtrim(col.cast("string"))
    # The JVM would also read "1d", "1f", "NaN", "Inf" and "Infinity"; their last letter tells.
    odd = F.right(text, F.lit(1)).isin("d", "D", "f", "F", "n", "N", "y", "Y")
    return F.when(~odd, text.try_cast("double"))


def number_of(df: DataFrame, name: str) -> Column:
    """A column as double: numbers need no parsing, text gets the lenient kind."""
    numeric = isinstance(df.schema[name].dataType, NumericType)
    return nan_to_null(F.col(name)) if numeric else lenient_double(F.col(name))


def locale_double(col: Column) -> Column:
    """Parse ``1.234,56``; dots are thousands marks only when a comma is present."""
    text = strip(col)
    swapped = F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return lenient_double(F.when(F.contains(text, F.lit(",")), swapped).otherwise(text))


def year_of_period(col: Column) -> Column:
    """Year of ``YYYYMM`` or ``MM/YYYY``."""
    text = strip(col)
    year = F.when(F.contains(text, F.lit("/")), F.right(text, F.lit(4))).otherwise(
        F.left(text, F.lit(4))
    )
    return year.try_cast("int")


def file_name_parts(name: Column, years: tuple[int, int] = (2000, 2030)) -> dict[str, Column]:
    """State, year and month of a file called ``RD<state><yy><mm>``.

    Two digits of a year stand for the last year they can mean by the end of ``years``. All parts
    are null when the name is of another kind or its year is outside the range.
    """
    first, last = years
    pattern = r"(?i)^RD(\w{2})(\d{2})(\d{2})(?:\.\w+)?$"
    part = lambda i: F.nullif(F.regexp_extract(name, pattern, i), F.lit(""))
    month = part(3).try_cast("int")
    year = F.lit(last) - F.pmod(F.lit(last) - part(2).try_cast("int"), F.lit(100))
    valid = month.between(1, 12) & year.between(first, last)
    return {
        "state": F.when(valid, F.upper(part(1))),
        "year": F.when(valid, year),
        "month": F.when(valid, month),
    }
