"""Hold-out splits and future months."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions.dates import date_literal, month_range
from tidecast.operators.packing import by_series

TRAINING, TESTING = "training", "testing"


def split_by_duration(panel: DataFrame, months: int = 12) -> DataFrame:
    """Mark the last ``months`` months of each series as testing, all before as training."""
    last = F.max("ds").over(Window.partitionBy("series_id"))
    training = F.col("ds") <= F.add_months(last, -months)
    return by_series(panel).withColumn("split_key", F.when(training, TRAINING).otherwise(TESTING))


def split_by_date(panel: DataFrame, cut: str) -> DataFrame:
    """Mark months before ``cut`` as training and all others as testing."""
    training = F.col("ds") < date_literal(cut)
    return panel.withColumn("split_key", F.when(training, TRAINING).otherwise(TESTING))


def training(split: DataFrame) -> DataFrame:
    return split.filter(F.col("split_key") == TRAINING).drop("split_key")


def testing(split: DataFrame) -> DataFrame:
    return split.filter(F.col("split_key") == TESTING).drop("split_key")


def split_plan(split: DataFrame, name: str = "Slice1") -> DataFrame:
    """The split as a long plan table: slice, part, and the columns of the panel."""
    columns = [c for c in split.columns if c != "split_key"]
    return split.select(F.lit(name).alias("id"), F.col("split_key").alias("key"), *columns)


def future_frame(panel: DataFrame, horizon: int, history: bool = False) -> DataFrame:
    """The ``horizon`` months after the last one of each series, optionally with its own months."""
    last = panel.groupBy("series_id").agg(F.max("ds").alias("last"))
    ahead = month_range(F.add_months("last", 1), F.add_months("last", horizon))
    future = last.select("series_id", F.explode(ahead).alias("ds"))
    return panel.select("series_id", "ds").unionByName(future) if history else future
