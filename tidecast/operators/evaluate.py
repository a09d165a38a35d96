"""The three model families side by side: fit, calibrate on held-out months, score."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions.metrics import accuracy_columns, mae, mape_fraction
from tidecast.operators import autoregression, smoothing, trend_season


@dataclass(frozen=True)
class Family:
    model_id: int
    model_desc: str
    fit: Callable[[DataFrame], DataFrame]
    predict: Callable[..., DataFrame]
    in_sample: Callable[[DataFrame, DataFrame], DataFrame]
    form: str
    coefficients: str


# The model numbers and names that result tables are filtered by.
FAMILIES = (
    Family(
        1,
        "ARIMA",
        autoregression.fit,
        autoregression.predict,
        autoregression.in_sample,
        "form",
        "concat(array(offset), weights, theta)",
    ),
    Family(
        2,
        "PROPHET",
        trend_season.fit,
        trend_season.predict,
        trend_season.in_sample,
        "format_string('trend with %d changepoints and yearly season', bends)",
        "beta",
    ),
    Family(
        3,
        "ETS",
        smoothing.fit,
        smoothing.predict,
        smoothing.in_sample,
        "form",
        "concat(array(alpha, beta, gamma, phi, level, slope), season_terms)",
    ),
)
MODEL_KEYS = ["series_id", "model_id", "model_desc"]

Models = list[tuple[Family, DataFrame]]


def fit_models(panel: DataFrame, *descs: str) -> Models:
    """Every family, or the named ones, fitted to every series of the panel."""
    chosen = [f for f in FAMILIES if not descs or f.model_desc in descs]
    return [(family, family.fit(panel)) for family in chosen]


def _tagged(df: DataFrame, family: Family, *columns: Column | str) -> DataFrame:
    return df.select(
        "series_id",
        F.lit(family.model_id).alias("model_id"),
        F.lit(family.model_desc).alias("model_desc"),
        *columns,
    )


def _stacked(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def model_table(models: Models) -> DataFrame:
    """One row per series and model: number, name, chosen form, months used and coefficients."""
    return _stacked(
        [
            _tagged(
                fitted,
                family,
                F.expr(family.form).alias("form"),
                "n_obs",
                F.expr(family.coefficients).alias("coefficients"),
            )
            for family, fitted in models
        ]
    )


def predict_models(models: Models, dates: DataFrame, *kept: str) -> DataFrame:
    """``(series_id, model_id, model_desc, ds, value)`` for every model on the given months.

    Columns of ``dates`` that are to be ``kept`` stand before the value.
    """
    return _stacked(
        [
            _tagged(family.predict(fitted, dates, *kept), family, "ds", *kept, "value")
            for family, fitted in models
        ]
    )


def fitted_values(models: Models, panel: DataFrame) -> DataFrame:
    """``(series_id, model_id, model_desc, ds, value)``: what every model makes of the months it was fitted to.

    ARIMA and ETS tell what they expected of a month from the months before it, which the first months do not
    have; PROPHET its curve.
    """
    return _stacked(
        [_tagged(family.in_sample(fitted, panel), family, "ds", "value") for family, fitted in models]
    )


def model_intervals(models: Models, dates: DataFrame, level: float = 0.95) -> DataFrame:
    """Predictions with normal intervals of the models' own, which widen with the months ahead.

    ``closed`` tells whether the form has such an interval; ETS with a multiplicative season has none, and
    its bounds are missing.
    """
    z = NormalDist().inv_cdf(0.5 + level / 2)
    ahead = _stacked(
        [
            _tagged(family.predict(fitted, dates, spread=True), family, "ds", "value", "spread")
            for family, fitted in models
        ]
    )
    return ahead.select(
        *MODEL_KEYS,
        "ds",
        "value",
        (F.col("value") - z * F.col("spread")).alias("conf_lo"),
        (F.col("value") + z * F.col("spread")).alias("conf_hi"),
        F.col("spread").isNotNull().alias("closed"),
    )


def calibrate(models: Models, test: DataFrame) -> DataFrame:
    """Observed, predicted and residual per model and held-out month.

    What was observed travels with its month through the predictions, so that nothing is joined by month.
    """
    return residuals(predict_models(models, test, "y"))


def residuals(predicted: DataFrame) -> DataFrame:
    """Residuals of predictions that kept the observed ``y``."""
    return predicted.select(
        *MODEL_KEYS,
        "ds",
        F.col("y").alias("actual"),
        F.col("value").alias("prediction"),
        (F.col("y") - F.col("value")).alias("residual"),
    )


def calibration_of(calibration: DataFrame, model_desc: str) -> DataFrame:
    return calibration.filter(F.col("model_desc") == model_desc)


def accuracy(calibration: DataFrame) -> DataFrame:
    """Error measures per series and model."""
    in_order = Window.partitionBy(*MODEL_KEYS).orderBy("ds")
    rows = calibration.withColumn("before", F.lag("actual").over(in_order))
    columns = accuracy_columns(F.col("actual"), F.col("prediction"), F.col("before"))
    return rows.groupBy(*MODEL_KEYS).agg(*columns)


def with_interval(forecast: DataFrame, calibration: DataFrame, level: float = 0.95) -> DataFrame:
    """Add a normal interval whose width comes from the held-out residuals of the same model."""
    z = NormalDist().inv_cdf(0.5 + level / 2)
    spread = calibration.groupBy(*MODEL_KEYS).agg(F.stddev_samp("residual").alias("spread"))
    return forecast.join(spread, MODEL_KEYS, "left").select(
        *forecast.columns,
        (F.col("value") - z * F.col("spread")).alias("conf_lo"),
        (F.col("value") + z * F.col("spread")).alias("conf_hi"),
    )


def forecast_vs_observed(forecast: DataFrame, observed: DataFrame, since: Column) -> DataFrame:
    """Predicted months from ``since`` on, with the observed value where there is one."""
    predicted = forecast.filter(F.col("ds") >= since)
    predicted = predicted.select("series_id", "ds", F.col("value").alias("yhat"))
    return predicted.join(observed.select("series_id", "ds", "y"), ["series_id", "ds"], "left")


def mae_mape(compared: DataFrame) -> DataFrame:
    """MAE and fractional MAPE per series; the forecast takes the place of the truth as divisor."""
    y, yhat = F.col("y"), F.col("yhat")
    return compared.groupBy("series_id").agg(
        mae(y, yhat).alias("mae"), mape_fraction(truth=yhat, predicted=y).alias("mape")
    )
