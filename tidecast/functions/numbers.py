"""Numeric expressions and aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_number(c: Column | str) -> Column:
    """Text to double: blanks around it are ignored, text that is no number is missing."""
    return _col(c).try_cast("double")


def round_half_even(c: Column | str) -> Column:
    return F.bround(_col(c), 0)


def strict(aggregate: Callable[[Column], Column], c: Column | str) -> Column:
    """``aggregate(c)``, but missing as soon as one input of the group is missing."""
    c = _col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), aggregate(c))


def strict_sum(c: Column | str) -> Column:
    return strict(F.sum, c)


def strict_mean(c: Column | str) -> Column:
    return strict(F.avg, c)
