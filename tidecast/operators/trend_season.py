"""Additive trend with changepoints and yearly seasonality, fitted to every series at once.

The model is the one of Taylor and Letham (2018, "Forecasting at scale"): a piecewise linear trend,
a yearly Fourier series, normal priors on slope, offset and Fourier terms, and a Laplace prior on
the changes of slope. The design table and the predictions are Spark expressions. Cross products are
aggregated per series, and the posterior mode is found from them by an active-set search: changes of slope
enter one by one by their gradient and leave when their sign would turn, until none can improve.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from tidecast.operators.least_squares import DOUBLES, cross_products, unpack
from tidecast.operators.packing import by_series

# Prior scales and sizes that the published model uses by default.
CHANGEPOINTS = 25
CHANGEPOINT_SHARE = 0.8
CHANGEPOINT_SCALE = 0.05
SEASON_ORDER = 10
SEASON_SCALE = 10.0
TREND_SCALE = 5.0
NOISE_SCALE = 0.5
YEAR_DAYS = 365.25
# Share of the ridge that keeps slope changes apart which the data cannot tell apart.
LEAST_RIDGE = 1e-6


def regressors() -> Column:
    """The design row of a date: offset, slope, one hinge per changepoint, Fourier pairs.

    Reads the columns ``ds, first, span, bends``. Written as SQL text, because some sixty terms are
    much faster to hand over as one expression than one by one.
    """
    t = "(datediff(ds, first) / span)"
    bend = f"greatest({t} - {CHANGEPOINT_SHARE}D * j / bends, 0D)"
    hinges = f"transform(if(bends > 0, sequence(1, bends), cast(array() AS array<int>)), j -> {bend})"
    angle = f"(unix_date(ds) * {2 * np.pi / YEAR_DAYS!r}D)"
    waves = [f"{f}({angle} * {k})" for k in range(1, SEASON_ORDER + 1) for f in ("sin", "cos")]
    return F.expr(f"concat(array(1D, {t}), {hinges}, array({', '.join(waves)}))")


def design(panel: DataFrame) -> DataFrame:
    """Panel rows with the axis of their series and their design row ``x``."""
    by = Window.partitionBy("series_id")
    months = F.count(F.lit(1)).over(by)
    room = F.floor(months * CHANGEPOINT_SHARE).cast("int") - 1
    largest = F.max(F.abs("y")).over(by)
    rows = by_series(panel.filter(F.col("y").isNotNull())).select(
        "series_id",
        "ds",
        "y",
        F.min("ds").over(by).alias("first"),
        F.greatest(F.datediff(F.max("ds").over(by), F.min("ds").over(by)), F.lit(1)).alias("span"),
        F.when(largest > 0, largest).otherwise(1.0).alias("scale"),
        F.greatest(F.least(F.lit(CHANGEPOINTS), room), F.lit(0)).alias("bends"),
    )
    return rows.withColumn("x", regressors())


def noise_variance(sse: float, n: int) -> float:
    """Mode of ``n log(s) + sse / (2 s^2) + s^2 / (2 NOISE_SCALE^2)`` over the variance ``s^2``."""
    c = 1 / NOISE_SCALE**2
    return max((np.sqrt(n * n + 4 * c * max(sse, 1e-12)) - n) / (2 * c), 1e-12)


def posterior_mode(
    xx: np.ndarray,
    xy: np.ndarray,
    yy: float,
    n: int,
    changepoint_scale: float = CHANGEPOINT_SCALE,
    steps: int = 1000,
    tolerance: float = 1e-9,
) -> tuple[np.ndarray, int, bool]:
    """Coefficients that minimise the negative log posterior, from cross products alone.

    For a given noise the posterior is convex: quadratic for given signs of the slope changes. A step
    solves for the signs at hand and goes there, or to where the first slope change on the way reaches zero.
    At the solution, the slope change with the largest gradient enters if the Laplace prior does not hold it
    at zero; if there is none, the noise follows the residuals. Also returns the steps taken and whether the
    last noise moved by less than the tolerance, with no slope change left to enter.
    """
    width = len(xy)
    hinge = np.zeros(width, dtype=bool)
    hinge[2 : width - 2 * SEASON_ORDER] = True
    # In units of the prior widths, the penalties are u^2 / 2 and |u|.
    root = np.where(hinge, changepoint_scale, SEASON_SCALE)
    root[:2] = TREND_SCALE
    ridge = np.where(hinge, LEAST_RIDGE, 1.0)
    gram, target = root[:, None] * xx * root, root * xy
    noise, u, sign = max(yy / n, 1e-12), np.zeros(width), np.zeros(width)
    for taken in range(1, steps + 1):
        on = np.flatnonzero(~hinge | (sign != 0))
        system = gram[np.ix_(on, on)] + np.diag(noise * ridge[on])
        new = np.zeros(width)
        new[on] = np.linalg.solve(system, target[on] - noise * sign[on])
        turned = (sign != 0) & (sign * new <= 0)
        if turned.any():
            share = np.full(width, np.inf)
            share[turned] = u[turned] / (u - new)[turned]
            first = int(np.argmin(share))
            u = u + share[first] * (new - u)
            u[first] = sign[first] = 0.0
            continue
        u = new
        pull = np.where(hinge & (sign == 0), target - gram @ u, 0.0) / noise
        enters = int(np.argmax(np.abs(pull)))
        if abs(pull[enters]) > 1 + 1e-9:
            sign[enters] = np.sign(pull[enters])
            continue
        before, noise = noise, noise_variance(yy - 2 * u @ target + u @ gram @ u, n)
        if abs(noise - before) <= tolerance * before:
            return root * u, taken, True
    return root * u, steps, False


MODE = StructType(
    [
        StructField("beta", DOUBLES),
        StructField("steps", IntegerType()),
        StructField("converged", BooleanType()),
        StructField("noise", DoubleType()),
    ]
)


@F.pandas_udf(MODE)
def _solve(products: pd.Series, n: pd.Series) -> pd.DataFrame:
    found = []
    for flat, months in zip(products, n):
        xx, xy, yy = unpack(flat)
        beta, steps, converged = posterior_mode(xx, xy, yy, int(months))
        noise = noise_variance(yy - 2 * beta @ xy + beta @ xx @ beta, int(months))
        found.append((beta, steps, converged, noise))
    return pd.DataFrame(found, columns=MODE.fieldNames())


def fit(panel: DataFrame) -> DataFrame:
    """One row per series: the time axis and the coefficients, on the scale of ``y / scale``."""
    target = F.array(F.col("y") / F.col("scale"))
    sums = (
        design(panel)
        .withColumn("z", F.concat("x", target))
        .groupBy("series_id", "first", "span", "scale", "bends")
        .agg(cross_products("z").alias("products"))
    )
    # The offset is the first regressor, so the first cross product counts the months.
    months = F.get("products", F.lit(0)).cast("int")
    return sums.withColumn("n_obs", months).select(
        "series_id",
        "first",
        "span",
        "scale",
        "bends",
        "n_obs",
        _solve("products", "n_obs").alias("mode"),
    ).select("series_id", "first", "span", "scale", "bends", "n_obs", "mode.*")


def _spread() -> Column:
    """Standard deviation of a month around its prediction, on the scale of ``y / scale``.

    Slope changes go on after the series as often as there are changepoints within it, each Laplace with
    the mean size of the fitted ones. A change at ``s`` moves the trend at ``t`` by ``t - s`` times its size, so
    together they add ``rate * 2 size^2 * t^3 / 3`` to the variance of the noise.
    """
    ahead = F.greatest(F.datediff("ds", "first") / F.col("span") - 1, F.lit(0.0))
    changes = F.aggregate(F.slice("beta", F.lit(3), F.col("bends")), F.lit(0.0), lambda acc, b: acc + F.abs(b))
    size = F.when(F.col("bends") > 0, changes / F.col("bends")).otherwise(0.0)
    return F.sqrt(F.col("noise") + F.col("bends") * 2 * size * size * ahead * ahead * ahead / 3)


def predict(fitted: DataFrame, dates: DataFrame, *kept: str, spread: bool = False) -> DataFrame:
    """``(series_id, ds, value)`` for rows ``(series_id, ds)``, past or future, and ``spread`` if asked.

    Columns of ``dates`` that are to be ``kept`` stand before the value.
    """
    rows = dates.select("series_id", "ds", *kept).join(fitted, "series_id")
    terms = F.zip_with(regressors(), F.col("beta"), lambda a, b: a * b)
    total = F.aggregate(terms, F.lit(0.0), lambda acc, term: acc + term)
    more = [(_spread() * F.col("scale")).alias("spread")] if spread else []
    return rows.select("series_id", "ds", *kept, (total * F.col("scale")).alias("value"), *more)


def in_sample(fitted: DataFrame, panel: DataFrame) -> DataFrame:
    """``(series_id, ds, value)`` on the months of the panel."""
    return predict(fitted, panel)
