"""Forecast error measures as aggregate expressions over observed and predicted columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidecast.functions.numbers import strict_mean

# Fixed value: smallest divisor of the fractional MAPE (double epsilon).
EPSILON = 2.220446049250313e-16


def mae(actual: Column, predicted: Column) -> Column:
    return F.avg(F.abs(actual - predicted))


def mape_percent(actual: Column, predicted: Column) -> Column:
    """Missing when any observed value is zero, because the ratio is then undefined."""
    return 100 * strict_mean(F.try_divide(F.abs(actual - predicted), F.abs(actual)))


def mape_fraction(truth: Column, predicted: Column) -> Column:
    """Mean of ``|truth - predicted| / |truth|``: the first argument is the divisor.

    Fixed-date scores pass the forecast as ``truth``.
    """
    return F.avg(F.abs(predicted - truth) / F.greatest(F.abs(truth), F.lit(EPSILON)))


def smape_percent(actual: Column, predicted: Column) -> Column:
    middle = (F.abs(actual) + F.abs(predicted)) / 2
    return 100 * strict_mean(F.try_divide(F.abs(actual - predicted), middle))


def rmse(actual: Column, predicted: Column) -> Column:
    return F.sqrt(F.avg((actual - predicted) * (actual - predicted)))


def r_squared(actual: Column, predicted: Column) -> Column:
    """Squared correlation; missing when either side does not vary."""
    spread = F.var_pop(actual) * F.var_pop(predicted)
    return F.try_divide(F.pow(F.covar_pop(actual, predicted), 2), spread)


def mase(actual: Column, predicted: Column, previous_actual: Column) -> Column:
    """Mean absolute error relative to that of repeating the previous observation."""
    return F.try_divide(mae(actual, predicted), F.avg(F.abs(actual - previous_actual)))


def accuracy_columns(actual: Column, predicted: Column, previous_actual: Column) -> list[Column]:
    return [
        mae(actual, predicted).alias("mae"),
        mape_percent(actual, predicted).alias("mape"),
        mase(actual, predicted, previous_actual).alias("mase"),
        smape_percent(actual, predicted).alias("smape"),
        rmse(actual, predicted).alias("rmse"),
        r_squared(actual, predicted).alias("rsq"),
    ]
