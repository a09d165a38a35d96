"""Text and date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_between(c: Column | str, start: int, stop: int) -> Column:
    """Characters ``start`` to ``stop``, both counted from 1 and both included."""
    return F.substring(_col(c), start, stop - start + 1)


def month_year(c: Column | str) -> Column:
    """``MMyyyy`` to the first day of the month; text that is no month is missing."""
    return F.try_to_date(_col(c), "MMyyyy")


def month_year_strict(c: Column | str) -> Column:
    """``MMyyyy`` to the first day of the month; text that is no month fails the query."""
    return F.to_date(_col(c), "MMyyyy")


def year_month(c: Column | str) -> Column:
    """``yyyy-MM`` to the first day of the month; text that is no month is missing."""
    return F.try_to_date(_col(c), "yyyy-MM")


def year_month_text(c: Column | str) -> Column:
    return F.date_format(_col(c), "yyyy-MM")


def month_start(c: Column | str) -> Column:
    return F.trunc(_col(c), "month")


def date_literal(text: str) -> Column:
    return F.lit(text).cast("date")


def months_apart(later: Column | str, earlier: Column | str) -> Column:
    """Whole months between two month starts."""
    later, earlier = _col(later), _col(earlier)
    return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)


def month_range(first: Column | str, last: Column | str) -> Column:
    return F.sequence(_col(first), _col(last), F.expr("INTERVAL 1 MONTH"))
