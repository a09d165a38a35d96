"""Autoregressive moving-average models with automatic choice of order.

Differencing orders come first, from Spark windows and folds: a seasonal difference when the
seasonal pattern is strong, an ordinary one when the KPSS statistic rejects a stable level. The
orders ``p``, ``q`` and ``P`` are then chosen by corrected AIC among least squares fits in the manner
of Hannan and Rissanen (1982): a long autoregression supplies the shocks that the moving-average
terms need. The seasonal autoregressive term is a plain lag of twelve months. The search goes up to
``MAX_P``, ``MAX_Q`` and ``MAX_SEASONAL_P``; a series that is too short for lags gets orders zero.

Everything goes by the calendar: a month without a value keeps its place, and a design row that touches
it is left out. Forecasts start from values in which such a month has the value of a year before, or else
the last one known.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from tidecast.operators.panel import complete_months

PERIOD = 12
MAX_P, MAX_Q, MAX_SEASONAL_P = 3, 2, 1
#: Series whose candidates are solved side by side.
TOGETHER = 128

#: Every candidate ``(p, q, P)``, and which columns it uses: constant, past values, past shocks.
ORDERS = np.array(list(product(range(MAX_P + 1), range(MAX_Q + 1), range(MAX_SEASONAL_P + 1))))
AR_LAGS, MA_LAGS = [*range(1, MAX_P + 1), PERIOD], list(range(1, MAX_Q + 1))
USES = np.column_stack(
    [
        np.ones(len(ORDERS), dtype=bool),
        ORDERS[:, :1] >= np.arange(1, MAX_P + 1),
        ORDERS[:, 2:] == MAX_SEASONAL_P,
        ORDERS[:, 1:2] >= np.array(MA_LAGS),
    ]
)

# Seasonal strength above which a series is differenced over the year, and the 5 %
# critical value of the KPSS statistic for a stable level.
SEASONAL_STRENGTH = 0.64
KPSS_CRITICAL = 0.463


def _stable_rows(panel: DataFrame) -> DataFrame:
    """Months with the strength of the yearly pattern and the values after a seasonal difference.

    Strength is the share of the variance around a centred twelve-month trend that the calendar
    month explains. ``centred`` is the deviation of the differenced value from its mean, and ``walk``
    the running sum of these deviations.
    """
    whole, by_time = Window.partitionBy("series_id"), Window.partitionBy("series_id").orderBy("ds")
    same_month = Window.partitionBy("series_id", "month")
    half = PERIOD // 2
    early = F.avg("y").over(by_time.rowsBetween(-half, half - 1))
    late = F.avg("y").over(by_time.rowsBetween(1 - half, half))
    inside = F.count("y").over(by_time.rowsBetween(-half, half)) == PERIOD + 1
    explained = 1 - F.try_divide(F.var_samp("left").over(whole), F.var_samp("around").over(whole))
    seasonal = (F.col("strength") > SEASONAL_STRENGTH) & (F.col("n_obs") >= 3 * PERIOD)
    year_before = F.lag("y", PERIOD).over(by_time)
    stable = F.when(F.col("seasonal_d") == 1, F.col("y") - year_before).otherwise(F.col("y"))
    so_far = by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    around = F.when(inside, F.col("y") - (early + late) / 2)
    latest = F.last("y", ignorenulls=True).over(by_time)
    return (
        complete_months(panel.filter(F.col("y").isNotNull()))
        .withColumns({"around": around, "month": F.month("ds")})
        .withColumn("filled", F.coalesce("y", year_before, latest))
        .withColumn("place", F.row_number().over(by_time))
        .withColumn("left", F.col("around") - F.avg("around").over(same_month))
        .withColumns(
            {
                "strength": F.greatest(explained, F.lit(0.0)),
                "n_obs": F.count("y").over(whole).cast("int"),
            }
        )
        .withColumn("seasonal_d", F.coalesce(seasonal, F.lit(False)).cast("int"))
        .withColumn("stable", stable)
        .withColumn("centred", F.col("stable") - F.avg("stable").over(whole))
        .withColumn("walk", F.sum("centred").over(so_far))
    )


def _in_order(column: str, after: Column | int = 0) -> Column:
    """Values of a column in month order, missing ones in place, without the first ``after`` months."""
    kept = F.when(F.col("place") > after, F.struct("ds", column))
    return F.transform(F.sort_array(F.collect_list(kept)), lambda m: m[column])


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))


def _known(values: Column) -> Column:
    return F.size(F.filter(values, lambda v: v.isNotNull()))


def _long_run_variance(centred: Column) -> Column:
    """Variance with Bartlett weights on ``3 sqrt(n) / 13`` autocovariances."""
    n, months = _known(centred), F.size(centred)
    lags = F.floor(3 * F.sqrt(n) / 13).cast("int")

    def weighted_covariance(j: Column) -> Column:
        later, earlier = F.slice(centred, j + 1, months - j), F.slice(centred, F.lit(1), months - j)
        covariance = _total(F.zip_with(later, earlier, lambda a, b: a * b)) / n
        return F.when(j == 0, 1.0).otherwise(2 * (1 - j / (lags + 1))) * covariance

    return _total(F.transform(F.sequence(F.lit(0), lags), weighted_covariance))


def difference(values: Column) -> Column:
    """Array of ``v[t] - v[t - 1]``; empty when there are too few values."""
    room = F.greatest(F.size(values) - 1, F.lit(0))
    later, earlier = F.slice(values, F.lit(2), room), F.slice(values, F.lit(1), room)
    return F.zip_with(later, earlier, lambda a, b: a - b)


def differencing_orders(panel: DataFrame) -> DataFrame:
    """Packed months with the seasonal and ordinary differencing orders and the statistics behind."""
    skipped = PERIOD * F.col("seasonal_d")
    walked = F.when(F.col("centred").isNotNull(), F.col("walk") * F.col("walk"))
    packed = (
        _stable_rows(panel)
        .groupBy("series_id", "n_obs", "strength", "seasonal_d")
        .agg(
            F.max("ds").alias("last"),
            _in_order("filled").alias("ys"),
            _in_order("stable", skipped).alias("stable"),
            _in_order("centred", skipped).alias("centred"),
            F.sum(walked).alias("squares"),
        )
    )
    n, variance = _known(F.col("stable")), F.col("variance")
    statistic = F.try_divide(F.col("squares"), n * n * F.when(variance > 1e-12, variance))
    once = F.coalesce(F.col("kpss") > KPSS_CRITICAL, F.lit(False))
    shifted = F.when(F.col("d") == 1, difference(F.col("stable"))).otherwise(F.col("stable"))
    return (
        packed.withColumn("variance", _long_run_variance(F.col("centred")))
        .withColumn("kpss", statistic)
        .withColumn("d", once.cast("int"))
        .withColumn("w", shifted)
        .select("series_id", "last", "n_obs", "ys", "w", "strength", "kpss", "d", "seasonal_d")
    )


def _lagged(values: np.ndarray, lags: list[int], start: int) -> np.ndarray:
    """One column per lag, for positions from ``start`` on."""
    return np.column_stack([values[start - k : len(values) - k] for k in lags])


def _shocks(w: np.ndarray) -> np.ndarray:
    """Residuals of a long autoregression; zero where it has no full set of lags."""
    shocks = np.zeros(len(w))
    order = min(PERIOD, len(w) // 5)
    if order:
        x = np.column_stack([np.ones(len(w) - order), _lagged(w, list(range(1, order + 1)), order)])
        y, full = w[order:], ~np.isnan(np.column_stack([x, w[order:]])).any(axis=1)
        if full.sum() > order:
            beta = np.linalg.lstsq(x[full], y[full], rcond=None)[0]
            shocks[order:][full] = y[full] - x[full] @ beta
    return shocks


def _stable(coefficients: np.ndarray) -> bool:
    """Whether ``x[t] = sum(c[k] x[t - k])`` dies out."""
    return bool(np.all(np.abs(np.roots(np.r_[1.0, -coefficients])) < 0.999))


def _design(w: np.ndarray, constant: bool) -> tuple:
    """Design rows and their targets, the rows' places, the orders a series may have, its mean and shocks.

    Columns that a series cannot have are zero. A series without enough months for lags, or with too many
    gaps between them, has its level only.
    """
    known = ~np.isnan(w)
    mean = float(w[known].mean()) if constant and known.any() else 0.0
    w = w - mean
    shocks = _shocks(w)
    longest_p = MAX_SEASONAL_P if len(w) >= 3 * PERIOD else 0
    start = max(min(PERIOD, len(w) // 5) + MAX_Q, MAX_P, PERIOD * longest_p)
    x, allowed = np.zeros((len(w), USES.shape[1])), ORDERS[:, 2] <= longest_p
    x[:, 0], full = 1.0, np.zeros(len(w), dtype=bool)
    if len(w) >= start + 3:
        lags = AR_LAGS if longest_p else AR_LAGS[:MAX_P]
        x[start:, 1 : 1 + len(lags)] = _lagged(w, lags, start)
        x[start:, 1 + len(AR_LAGS) :] = _lagged(shocks, MA_LAGS, start)
        full[start:] = ~np.isnan(np.column_stack([x, w])[start:]).any(axis=1)
    if full.sum() < 3:
        x[:, 1:], full, allowed = 0.0, known, ORDERS.sum(axis=1) == 0
    return x[full], w[full], np.flatnonzero(full), allowed, mean, shocks


def choose_orders(series: list[np.ndarray], differences: list[int]) -> list[dict]:
    """For every series the stable, invertible candidate with the smallest corrected AIC on common months.

    All candidates of all series are solved in one stack of normal equations, in which the columns that a
    candidate leaves out are zero. Fits with a constant, that is after fewer than two differences, run on
    deviations from the mean, which keeps their cross products accurate. A series may have missing values
    (NaN) in their places.
    """
    constant = np.array([d < 2 for d in differences], dtype=bool)
    designs = [_design(w, bool(c)) for w, c in zip(series, constant)]
    uses = USES & (constant[:, None, None] | (np.arange(USES.shape[1]) > 0))
    xx = np.array([x.T @ x for x, *_ in designs])[:, None]
    xy = np.array([x.T @ y for x, y, *_ in designs])[:, None]
    both = uses[:, :, :, None] & uses[:, :, None, :]
    inverse = np.linalg.pinv(np.where(both, xx, 0.0), rcond=xx.shape[-1] * np.finfo(float).eps, hermitian=True)
    betas = np.where(uses, (inverse @ xy[..., None])[..., 0], 0.0)
    return [
        _best(w, *design, beta, used.sum(axis=1) + 1)
        for w, design, beta, used in zip(series, designs, betas, uses)
    ]


def _best(w, x, y, place, allowed, mean, shocks, beta, k) -> dict:
    """The chosen one of a series' candidates, of which each has a row of ``beta`` and ``k`` parameters."""
    n = len(y)
    left = y[:, None] - x @ beta.T
    sse, room = np.sum(left**2, axis=0), n - k - 1
    allowed = allowed & ((room > 0) | (ORDERS.sum(axis=1) == 0))
    fit = n * np.log(np.maximum(sse, 1e-12) / max(n, 1)) + 2 * k
    aicc = np.where(allowed, fit + 2 * k * (k + 1) / np.maximum(room, 1), np.inf)
    for c in np.argsort(aicc, kind="stable").tolist():
        phi = np.zeros(PERIOD)
        phi[np.array(AR_LAGS) - 1] = beta[c, 1 : 1 + len(AR_LAGS)]
        theta = beta[c, 1 + len(AR_LAGS) :]
        if _stable(phi) and _stable(-theta):
            break
    residuals = [None] * len(w)
    for at, value in zip(place.tolist(), left[:, c].tolist()):
        residuals[at] = value
    p, q, seasonal_p = ORDERS[c].tolist()
    return {
        "aicc": float(aicc[c]),
        "p": p,
        "q": q,
        "seasonal_p": seasonal_p,
        "sse": float(sse[c]),
        "offset": float(beta[c, 0]) + mean * (1 - phi.sum()),
        "phi": phi,
        "theta": theta,
        "shocks": shocks[: -MAX_Q - 1 : -1],
        "residuals": residuals,
        "variance": float(sse[c]) / max(n, 1),
    }


def choose_order(w: np.ndarray, differences: int) -> dict:
    """The choice for one series; see ``choose_orders``."""
    return choose_orders([w], [differences])[0]


def level_weights(phi: np.ndarray, d: int, seasonal_d: int) -> np.ndarray:
    """Weights of the past values themselves, with the differences multiplied out."""
    weights = np.r_[1.0, -phi]
    for order, lag in ((d, 1), (seasonal_d, PERIOD)):
        if order:
            weights = np.convolve(weights, np.r_[1.0, np.zeros(lag - 1), -1.0])
    return -weights[1:]


FITTED = StructType(
    [
        *[StructField(c, IntegerType()) for c in ("p", "q", "seasonal_p")],
        StructField("offset", DoubleType()),
        *[StructField(c, ArrayType(DoubleType())) for c in ("weights", "theta", "shocks", "residuals")],
        *[StructField(c, DoubleType()) for c in ("sse", "aicc", "variance")],
    ]
)


@F.pandas_udf(FITTED)
def _estimate(w: pd.Series, d: pd.Series, seasonal_d: pd.Series) -> pd.DataFrame:
    rows = []
    every = [np.asarray(values, dtype=float) for values in w]
    differences = (d + seasonal_d).tolist()
    for first in range(0, len(every), TOGETHER):
        part = slice(first, first + TOGETHER)
        rows += choose_orders(every[part], differences[part])
    for found, once, yearly in zip(rows, d, seasonal_d):
        found["weights"] = level_weights(found["phi"], once, yearly)
    return pd.DataFrame(rows, columns=FITTED.fieldNames())


def fit(panel: DataFrame) -> DataFrame:
    """One row per series: orders, weights of past values and shocks, and the last months.

    ``residuals`` are those of the design rows, the last one that of the last month, missing elsewhere;
    ``variance`` is theirs.
    """
    fitted = differencing_orders(panel).withColumn("best", _estimate("w", "d", "seasonal_d"))
    longest = 2 * PERIOD + 1
    orders = F.format_string(
        "ARIMA(%d,%d,%d)(%d,%d,0)[12]", "best.p", "d", "best.q", "best.seasonal_p", "seasonal_d"
    )
    recent = F.slice(F.reverse("ys"), 1, longest).alias("recent")
    columns = ["series_id", "last", "n_obs", "d", "seasonal_d", "best.*"]
    return fitted.select(*columns, orders.alias("form"), recent)


def predict(fitted: DataFrame, dates: DataFrame, *kept: str, spread: bool = False) -> DataFrame:
    """``(series_id, ds, value)`` for rows ``(series_id, ds)`` after the last fitted month, ``spread`` if asked.

    Columns of ``dates`` that are to be ``kept`` travel with their month and stand before the value. The recurrence runs once per series, up to its furthest month, and each month is then read off. So does
    the response to a single shock, whose squares add up to the variance of a month around its prediction.
    """
    wanted = dates.groupBy("series_id").agg(
        F.max("ds").alias("furthest"), F.collect_list(F.struct("ds", *kept)).alias("months")
    )
    rows = wanted.join(fitted, "series_id").filter(F.col("furthest") > F.col("last"))
    ahead = F.months_between("furthest", "last").cast("int")

    def shock(i: Column) -> Column:
        theta, e = F.col("theta"), F.col("shocks")
        first, second = F.get(e, F.lit(0)), F.get(e, F.lit(1))
        both = F.get(theta, F.lit(0)) * first + F.get(theta, F.lit(1)) * F.coalesce(second, F.lit(0.0))
        return F.when(i == 1, both).when(i == 2, F.get(theta, F.lit(1)) * first).otherwise(0.0)

    def step(past: Column, i: Column) -> Column:
        pulls = F.zip_with("weights", past, lambda a, v: F.coalesce(a * v, F.lit(0.0)))
        return F.concat(F.array(F.col("offset") + _total(pulls) + shock(i)), past)

    def response(past: Column, i: Column) -> Column:
        pulls = F.zip_with("weights", past, lambda a, v: F.coalesce(a * v, F.lit(0.0)))
        return F.concat(F.array(F.coalesce(F.get("theta", i - 1), F.lit(0.0)) + _total(pulls)), past)

    months = F.sequence(F.lit(1), ahead)
    columns = {"path": F.aggregate(months, F.col("recent"), step)}
    if spread:
        columns["responses"] = F.reverse(F.aggregate(months, F.array(F.lit(1.0)), response))
    paths = [column.alias(name) for name, column in columns.items()]
    each = rows.select("series_id", "last", "variance", ahead.alias("ahead"), *paths, F.inline("months"))
    reached = F.months_between("ds", "last").cast("int")
    squares = F.transform(F.slice("responses", F.lit(1), reached), lambda v: v * v)
    more = [F.sqrt(F.col("variance") * _total(squares)).alias("spread")] if spread else []
    return each.filter(F.col("ds") > F.col("last")).select(
        "series_id", "ds", *kept, F.get("path", F.col("ahead") - reached).alias("value"), *more
    )


def in_sample(fitted: DataFrame, panel: DataFrame) -> DataFrame:
    """``(series_id, ds, value)``: the panel's values less the residuals of the fit, where it has them."""
    rows = fitted.select("series_id", "last", F.size("residuals").alias("n"), F.posexplode("residuals").alias("at", "residual"))
    ds = F.add_months("last", F.col("at") - F.col("n") + 1).alias("ds")
    rows = rows.filter(F.col("residual").isNotNull()).select("series_id", ds, "residual")
    joined = rows.join(panel.select("series_id", "ds", "y"), ["series_id", "ds"])
    return joined.select("series_id", "ds", (F.col("y") - F.col("residual")).alias("value"))
