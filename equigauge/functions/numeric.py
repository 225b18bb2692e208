"""Null-safe arithmetic and the standard ratio measures."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clip(col: Column, low: Column, high: Column) -> Column:
    """Value held inside [low, high]; null stays null."""
    return F.when(col.isNotNull(), F.least(F.greatest(col, low), high))


def ratio(numerator: Column, denominator: Column, scale: float = 1.0) -> Column:
    """scale * numerator / denominator as double; null when the denominator is zero."""
    return F.try_divide(numerator.cast("double") * F.lit(float(scale)), denominator.cast("double"))


def ratio_of_sums(numerator: str, denominator: str, scale: float = 1.0) -> Column:
    return ratio(F.sum(numerator), F.sum(denominator), scale)


def money_sum(col: str | Column) -> Column:
    """Sum of amounts at the scale of their column: decimals stay exact, doubles stay doubles.

    Nothing is rounded before it is added; tables that show cents round the total.
    """
    return F.sum(col)


def half_even(col: Column, digits: int) -> Column:
    """Round half to even, as published tables do."""
    return F.bround(col, digits)


def whole(col: Column) -> Column:
    """A float count as an integer, half to even; in doubles, without a decimal for every value."""
    return F.rint(col.cast("double")).cast("long")
