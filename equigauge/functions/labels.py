"""Labels for years, periods and signs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from equigauge.config import BETTER, STABLE, WORSE, Study


def block_of_year(year: Column, study: Study) -> Column:
    """Block label of a year; the open block takes every year not named by another."""
    return _by_block(year, study, lambda b: b.label)


def block_order(year: Column, study: Study) -> Column:
    return _by_block(year, study, lambda b: b.order)


def _by_block(year: Column, study: Study, value) -> Column:
    named = [b for b in study.blocks if b.years is not None]
    rest = [b for b in study.blocks if b.years is None]
    out = F.when(F.lit(False), F.lit(None))
    for block in named:
        out = out.when(year.isin(*block.years), F.lit(value(block)))
    return out.otherwise(F.lit(value(rest[0]))) if rest else out


def period_of_year(year: Column, study: Study, outside: str = "") -> Column:
    """Label of the comparison period a year belongs to."""
    out = F.when(F.lit(False), F.lit(None))
    for period in study.periods:
        out = out.when(year.isin(*period.years), F.lit(period.label))
    return out.otherwise(F.lit(outside))


def name_with_state(name: Column, state: Column) -> Column:
    return F.concat(name, F.lit(" ("), state, F.lit(")"))


def change_label(change: Column) -> Column:
    """Sign of an (already rounded) change; zero and null count as stable."""
    return (
        F.when(change > 0, F.lit(WORSE)).when(change < 0, F.lit(BETTER)).otherwise(F.lit(STABLE))
    )
