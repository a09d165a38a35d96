"""Event records to a monthly panel ``(series_id, ds, y)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions.dates import month_range
from tidecast.functions.numbers import strict_sum
from tidecast.operators.packing import by_series


def month_totals(
    events: DataFrame, keys: Sequence[str | Column], month: Column, value: str | None = None
) -> DataFrame:
    """Count events, or sum ``value``, per key and month; the month column is ``ds``."""
    total = F.count(F.lit(1)).cast("double") if value is None else strict_sum(value).cast("double")
    return events.groupBy(*keys, month.alias("ds")).agg(total.alias("y"))


def month_series(
    events: DataFrame,
    code: str,
    month: Column,
    regions: DataFrame,
    region_code: str,
    region: str,
    value: str | None = None,
    count_codes_first: bool = False,
) -> DataFrame:
    """Monthly totals per region, for events that carry a code of that region.

    Events meet ``regions`` and are totalled per region and month in the same stage. Regions that fit
    a broadcast cost no shuffle of the events; others cost one, and a code that holds a large share of
    all events is split by adaptive execution. Where most codes hold very many events of a month,
    ``count_codes_first`` totals them per (code, month) before the join. Codes without a region, and
    regions spelled ``NA``, are left out.
    """
    if count_codes_first:
        events = month_totals(events, [code], month, value)
        month, value = F.col("ds"), "y"
    labelled = events.join(regions, events[code] == regions[region_code], "left")
    named = labelled.filter(F.col(region) != "NA")
    return month_totals(named, [F.col(region).alias("series_id")], month, value)


def with_total_series(panel: DataFrame, name: str = "ALL") -> DataFrame:
    """Add one series that is the sum of all others per month, in one pass over the panel.

    A series that has the name already is an error.
    """
    taken = F.raise_error(F.concat(F.lit("a series has the name of the total: "), F.col("series_id")))
    own = F.when(F.col("series_id") == name, taken.cast("string")).otherwise(F.col("series_id"))
    both = F.explode(F.array(own, F.lit(name))).alias("series_id")
    return panel.select(both, "ds", "y").groupBy("series_id", "ds").agg(strict_sum("y").alias("y"))


def periods(panel: DataFrame) -> DataFrame:
    return panel.select("ds").distinct()


def slice_series(panel: DataFrame, series: str) -> DataFrame:
    """The months of one series, without its name."""
    return panel.filter(F.col("series_id") == series).drop("series_id")


def complete_months(panel: DataFrame, fill: float | None = None) -> DataFrame:
    """One row for every month between the first and the last of each series.

    Each month brings the missing ones up to the next, so the panel is read once and not joined.
    """
    following = F.lead("ds").over(Window.partitionBy("series_id").orderBy("ds"))
    until = F.coalesce(F.add_months(following, -1), F.col("ds"))
    rows = by_series(panel).select("series_id", F.col("ds").alias("known"), "y", until.alias("until"))
    months = rows.select("series_id", F.explode(month_range("known", "until")).alias("ds"), "known", "y")
    value = F.when(F.col("ds") == F.col("known"), F.col("y")).otherwise(F.lit(fill))
    return months.select("series_id", "ds", value.alias("y"))


def row_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def frame_profile(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, number of rows and of values that are not missing."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(f"`{c}`").alias(f"_{i}") for i, c in enumerate(df.columns)],
    )
    lines = [
        F.struct(
            F.lit(i + 1).alias("position"),
            F.lit(field.name).alias("column_name"),
            F.lit(field.dataType.simpleString()).alias("column_type"),
            F.col("_rows").alias("row_count"),
            F.col(f"_{i}").alias("value_count"),
        )
        for i, field in enumerate(df.schema.fields)
    ]
    return counts.select(F.inline(F.array(*lines)))


def first_rows(df: DataFrame, keys: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*keys).limit(n)
