"""Forecast tables and their monthly rollups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.functions.dates import date_literal, year_month, year_month_text
from tidecast.functions.numbers import strict_sum
from tidecast.operators.evaluate import Models, fit_models, fitted_values, predict_models, with_interval
from tidecast.operators.split import future_frame

ACTUAL, PREDICTION = "actual", "prediction"


def refit(panel: DataFrame, *descs: str) -> Models:
    """The same families, fitted to the whole panel instead of its training months."""
    return fit_models(panel, *descs)


def forecast_future(models: Models, panel: DataFrame, horizon: int) -> DataFrame:
    return predict_models(models, future_frame(panel, horizon))


def in_sample(models: Models, panel: DataFrame) -> DataFrame:
    """Fitted values on the months of the panel that a model has one for."""
    return fitted_values(models, panel)


def forecast_with_actuals(
    predictions: DataFrame, panel: DataFrame, calibration: DataFrame | None = None
) -> DataFrame:
    """Observed and predicted rows in one table, predictions with an interval if calibrated."""
    if calibration is None:
        missing = F.lit(None).cast("double")
        ranged = predictions.withColumns({"conf_lo": missing, "conf_hi": missing})
    else:
        ranged = with_interval(predictions, calibration)
    ahead = ranged.select(
        "series_id",
        "model_id",
        "model_desc",
        F.lit(PREDICTION).alias("key"),
        F.col("ds").alias("index"),
        "value",
        "conf_lo",
        "conf_hi",
    )
    observed = panel.select(
        "series_id",
        F.lit("ACTUAL").alias("model_desc"),
        F.lit(ACTUAL).alias("key"),
        F.col("ds").alias("index"),
        F.col("y").alias("value"),
    )
    return observed.unionByName(ahead, allowMissingColumns=True).select(*ahead.columns)


def _rollup(rows: DataFrame, tag: str) -> DataFrame:
    months = rows.groupBy(
        F.col("series_id").alias("regiao"),
        year_month_text("index").alias("mes_ano"),
        F.year("index").alias("ano"),
    )
    return months.agg(strict_sum("value").alias("total")).select(
        "mes_ano", "ano", "total", F.lit(tag).alias("tipo"), "regiao"
    )


def forecast_rollup(table: DataFrame, model_desc: str = "PROPHET") -> DataFrame:
    """Predicted totals per month and year for one model."""
    chosen = (F.col("key") == PREDICTION) & (F.col("model_desc") == model_desc)
    return _rollup(table.filter(chosen), "previsto")


def actual_rollup(table: DataFrame, after: str = "2015-01-01") -> DataFrame:
    """Observed totals per month and year, for months after the given date."""
    chosen = (F.col("key") == ACTUAL) & (F.col("index") > date_literal(after))
    return _rollup(table.filter(chosen), "atual")


def combined(rollups: Sequence[DataFrame]) -> DataFrame:
    """Stack rollups and add the month as a date."""
    stacked = reduce(DataFrame.unionByName, rollups)
    return stacked.withColumn("mes_ano_data", year_month("mes_ano"))
