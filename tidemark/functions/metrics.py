"""Error metrics and small scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def absolute_error(actual: Column, predicted: Column) -> Column:
    return F.abs(actual - predicted)


def squared_error(actual: Column, predicted: Column) -> Column:
    return (actual - predicted) * (actual - predicted)


def smape(actual: Column, predicted: Column) -> Column:
    """In percent of the mean size; 0 where both are 0."""
    size = F.abs(actual) + F.abs(predicted)
    return F.when(size == 0, F.lit(0.0)).otherwise(F.lit(200.0) * F.abs(predicted - actual) / size)


def scaled(error: Column, scale: Column) -> Column:
    """The error in units of the scale, which has to be finite and positive."""
    ok = scale.isNotNull() & ~F.isnan(scale) & (scale > 0) & (scale != float("inf"))
    return F.when(ok, error / scale).otherwise(F.raise_error(F.lit("the scale of errors is not positive")).cast("double"))


def month_distance(start: Column, end: Column) -> Column:
    """Months from start to end, both included."""
    return (F.months_between(end, start) + 1).cast("int")


def days_in_month(month: Column) -> Column:
    return F.day(F.last_day(month))


def wrap_angle(value: Column, target: float = 0.0) -> Column:
    """The difference from ``target`` in degrees, from -180 up to 180."""
    return F.pmod(value - F.lit(target) + 180, F.lit(360.0)) - 180


def julian_to_timestamp(jd: Column) -> Column:
    return F.timestamp_seconds((jd - 2440587.5) * 86400)


def overlap_length(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length shared by two intervals; an instant inside the second one counts as 1."""
    instant = F.when((a0 >= b0) & (a0 <= b1), F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(a0 == a1, instant).otherwise(F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0)))


def requirement(volume: Column, per: float, minimum: int = 0) -> Column:
    """Units of a resource for a volume, ``per`` a unit, rounded up, at least ``minimum``."""
    return F.greatest(F.lit(minimum).cast("long"), F.ceil(volume / per))


def parse_count(text: Column) -> Column:
    """Digits with commas or spaces between them as a long; null for anything else."""
    bare = F.regexp_replace(text, "[, ]", "")
    return F.when(bare.rlike("^[0-9]+$"), bare.cast("long"))


# Names of units and their sizes.
UNITS = {"absolute": 1, "thousand": 1_000, "lakh": 100_000, "million": 1_000_000, "crore": 10_000_000}


def scale_unit(text: Column, unit: str) -> Column:
    """A decimal number of units as a whole count, exact; null where that is not whole or not a number."""
    exact = F.regexp_replace(text, "[, ]", "").try_cast("decimal(28,9)") * F.lit(UNITS[unit])
    return F.when(exact == F.round(exact, 0), exact.cast("long"))


def fingerprint(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 12)
