"""Placement of the panel by series, and one packed row per series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.functions.dates import month_range


def by_series(panel: DataFrame) -> DataFrame:
    """All months of a series in one partition, series spread over all shuffle partitions.

    One shuffle serves every window, fold and fit that follows. The number of partitions is given
    explicitly, because adaptive coalescing looks at bytes only: a panel is small in bytes, but each
    of its series costs several model fits. A series holds one row per calendar month, so no
    partition depends on how many events were counted.
    """
    partitions = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return panel.repartition(partitions, "series_id")


def pack_series(panel: DataFrame) -> DataFrame:
    """``(series_id, last, ys)`` with one value per calendar month of a series, missing ones in place.

    A series starts and ends with a value. Its array is as long as its span of months, whether a month
    in between has no row or a row without a value.
    """
    rows = by_series(panel.filter(F.col("y").isNotNull()))
    known = F.map_from_entries(F.collect_list(F.struct("ds", "y"))).alias("known")
    spans = rows.groupBy("series_id").agg(F.min("ds").alias("first"), F.max("ds").alias("last"), known)
    values = F.transform(month_range("first", "last"), lambda month: F.try_element_at("known", month))
    return spans.select("series_id", "last", values.alias("ys"))
