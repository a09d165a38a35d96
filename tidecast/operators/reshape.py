"""Wide/long reshapes and whole-row aggregates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.functions.numbers import strict_mean, strict_sum


def columns_with_prefix(df: DataFrame, prefix: str) -> list[str]:
    """Names that start with ``prefix``, whatever their case."""
    return [c for c in df.columns if c.lower().startswith(prefix.lower())]


def columns_between(df: DataFrame, first: int, last: int) -> list[str]:
    """Names at positions ``first`` to ``last``, both counted from 1 and both included."""
    return df.columns[first - 1 : last]


def summarise_all(
    df: DataFrame, keys: Sequence[str], aggregate: Callable[[str], Column]
) -> DataFrame:
    """Apply one aggregate to every column that is not a key."""
    measures = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*[aggregate(f"`{c}`").alias(c) for c in measures])


def mean_all(df: DataFrame, *keys: str) -> DataFrame:
    return summarise_all(df, keys, strict_mean)


def sum_all(df: DataFrame, *keys: str) -> DataFrame:
    return summarise_all(df, keys, strict_sum)


def to_long(df: DataFrame, columns: Sequence[str], key: str, value: str) -> DataFrame:
    """One row per input row and column of ``columns``; missing values are kept."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.unpivot(kept, [F.col(f"`{c}`") for c in columns], key, value)


def to_wide(
    df: DataFrame, key: str, value: str, levels: Sequence[str], duplicates: str = "fail"
) -> DataFrame:
    """One column per level of ``key``; every other column identifies the row.

    Two rows for one cell fail the query, or are added up with ``duplicates="sum"``. All levels are
    aggregated in one pass, so there is one shuffle, on the identifying columns.
    """
    if duplicates not in ("fail", "sum"):
        raise ValueError(f"duplicates must be 'fail' or 'sum', not {duplicates!r}")
    ids = [c for c in df.columns if c not in (key, value)]

    def cell(level: str) -> Column:
        here = F.col(key) == level
        rows, total = F.count_if(here), F.sum(F.when(here, F.col(value)))
        whole = F.when(rows == F.count(F.when(here, F.col(value))), total)
        if duplicates == "sum":
            return whole
        place = F.to_json(F.struct(*ids, F.lit(level).alias(key)))
        return F.when(rows > 1, F.raise_error(F.concat(F.lit("repeated cell "), place))).otherwise(
            whole
        )

    return df.groupBy(*ids).agg(*[cell(level).alias(level) for level in levels])


def split_in_two(df: DataFrame, column: str, into: tuple[str, str], delimiter: str) -> DataFrame:
    """Replace a text column by its first two parts; further parts are dropped."""
    parts = F.split(F.col(f"`{column}`"), delimiter)
    pieces = [F.get(parts, F.lit(i)).alias(name) for i, name in enumerate(into)]
    selected: list[Column] = []
    for c in df.columns:
        selected += pieces if c == column else [F.col(f"`{c}`")]
    return df.select(*selected)
