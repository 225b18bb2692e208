"""Coded ages and value bands."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from equigauge.config import Bands

# Unit codes of a recorded age (fixed values).
DAYS, MONTHS, YEARS, YEARS_OVER_HUNDRED = 2, 3, 4, 5


def age_in_years(value: Column, unit: Column) -> Column:
    """Whole years; days and months are 0, unknown units and negative ages are null.

    Takes numbers (see `lenient_double` and `number_of` for text).
    """
    years = (
        F.when(unit == YEARS, value)
        .when(unit.isin(DAYS, MONTHS), F.lit(0.0))
        .when(unit == YEARS_OVER_HUNDRED, value + F.lit(100.0))
    )
    return F.when(years >= 0, years)


def band_of(value: Column, bands: Bands) -> Column:
    """Label of the right-closed band that holds the value; null and NaN give null."""
    number = value.try_cast("double")
    label = F.when(number.isNull() | F.isnan(number), F.lit(None).cast("string"))
    for name, limit in zip(bands.labels, bands.limits):
        label = label.when(number <= F.lit(float(limit)), F.lit(name))
    return label.otherwise(F.lit(bands.labels[-1]))


def band_order(label: Column, bands: Bands) -> Column:
    """1-based position of a band label, for sorting."""
    order = F.when(F.lit(False), F.lit(0))
    for position, name in enumerate(bands.labels, start=1):
        order = order.when(label == name, F.lit(position))
    return order
