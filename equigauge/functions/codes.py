"""Membership tests on codes and constant look-ups."""

from __future__ import annotations

from itertools import chain
from typing import Iterable, Mapping

from pyspark.sql import Column, functions as F

from equigauge.config import STATE_BY_CODE, STATES_BY_REGION
from equigauge.functions.text import clean_upper, strip


def has_prefix(col: Column, prefixes: Iterable[str]) -> Column:
    """True when the cleaned code starts with one of the prefixes; null is false."""
    by_length: dict[int, list[str]] = {}
    for prefix in prefixes:
        by_length.setdefault(len(prefix), []).append(prefix)
    code = clean_upper(col)
    hit = F.lit(False)
    for length, group in sorted(by_length.items()):
        hit = hit | F.substring(code, 1, length).isin(*group)
    return F.coalesce(hit, F.lit(False))


def has_padded_prefix(col: Column, prefix: str, width: int = 10) -> Column:
    """True when the zero-padded code starts with the prefix; null is false.

    ``lpad`` cuts longer codes, which cannot change a prefix shorter than the width.
    """
    padded = F.lpad(strip(col), width, "0")
    return F.coalesce(F.startswith(padded, F.lit(prefix)), F.lit(False))


def constant_map(mapping: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


def look_up(col: Column, mapping: Mapping) -> Column:
    """Value of a small constant map; unmatched and null give null."""
    return F.try_element_at(constant_map(mapping), col)


def state_of_code(col: Column, states: Mapping[int, str] = STATE_BY_CODE) -> Column:
    prefix = F.left(strip(col), F.lit(2)).try_cast("int")
    return look_up(prefix, dict(states))


def region_of_state(col: Column, regions: Mapping[str, Iterable[str]] = STATES_BY_REGION) -> Column:
    by_state = {s: region for region, states in regions.items() for s in states}
    return look_up(clean_upper(col), by_state)
