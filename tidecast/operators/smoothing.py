"""Exponential smoothing with automatic choice of form, searched over a fixed candidate grid.

Each candidate is a form (trend none, additive or damped; season none, additive or multiplicative)
with its smoothing weights. All candidates of many series are carried through the months together, one
array operation per step; the smallest corrected AIC wins and ties go to the earlier candidate.
A missing month moves the level along the trend and changes nothing else. Seasonal forms need two
calendar years with values, multiplicative ones values above zero; ``left_out`` names the seasons that
a series could not have.
Packing, candidate columns, forecasts and everything after them are Spark expressions.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
)

from tidecast.operators.packing import pack_series

PERIOD = 12

# Candidate weights. beta is a share of alpha and gamma a share of 1 - alpha, which keeps every
# candidate inside the usual admissible region of the models.
ALPHAS = (0.01, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9)
BETA_SHARES = (0.02, 0.1, 0.3)
GAMMA_SHARES = (0.05, 0.2, 0.5)
DAMPINGS = (0.85, 0.95)

# Start values, weights and variance that each form estimates.
TREND_SIZE = {"N": 0, "A": 2, "Ad": 3}
SEASON_SIZE = {"N": 0, "A": PERIOD, "M": PERIOD}


def candidates(
    trends: tuple[str, ...] = ("N", "A", "Ad"), seasons: tuple[str, ...] = ("N", "A", "M")
) -> pd.DataFrame:
    """The candidate grid; ``k`` is the number of parameters that the corrected AIC charges for."""
    rows = []
    for trend, season in product(trends, seasons):
        betas = BETA_SHARES if trend != "N" else (0.0,)
        dampings = DAMPINGS if trend == "Ad" else (1.0,)
        gammas = GAMMA_SHARES if season != "N" else (0.0,)
        k = 3 + TREND_SIZE[trend] + SEASON_SIZE[season]
        for alpha, beta, gamma, phi in product(ALPHAS, betas, gammas, dampings):
            rows.append((trend, season, alpha, alpha * beta, (1 - alpha) * gamma, phi, k))
    columns = ["trend", "season", "alpha", "beta", "gamma", "phi", "k"]
    grid = pd.DataFrame(rows, columns=columns)
    grid.insert(0, "grid_id", range(1, len(grid) + 1))
    return grid


def start_values(y: np.ndarray, trended: np.ndarray, season: np.ndarray) -> tuple:
    """Months used up by the start, then level, slope and season terms of every candidate.

    With two years of data the slope is the change between the yearly means, and the season terms
    are what the first year leaves around that line. A month that is missing there takes its term from
    the second year, or a neutral one. A shorter series starts from its first months.
    """
    if not two_years(y):
        second = y[1] if len(y) > 1 and not np.isnan(y[1]) else y[0]
        slope = np.where(trended, second - y[0], 0.0)
        return 1, np.full(len(trended), y[0]), slope, np.zeros((PERIOD, len(trended)))
    first, second = np.nanmean(y[:PERIOD]), np.nanmean(y[PERIOD : 2 * PERIOD])
    slope = np.where(trended, (second - first) / PERIOD, 0.0)
    middle = (PERIOD - 1) / 2
    line = first + (np.arange(2 * PERIOD)[:, None] - middle) * slope
    years = y[: 2 * PERIOD, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(season == "A", years - line, np.where(season == "M", years / line, 0.0))
    terms = np.where(np.isnan(years), np.nan, terms)
    neutral = np.where(season == "M", 1.0, 0.0)
    start = np.where(np.isnan(terms[:PERIOD]), terms[PERIOD:], terms[:PERIOD])
    return PERIOD, first + middle * slope, slope, np.where(np.isnan(start), neutral, start)


def two_years(y: np.ndarray) -> bool:
    """Whether each of the first two years has a value, which the seasonal forms need."""
    known = ~np.isnan(y)
    return len(y) >= 2 * PERIOD and bool(known[:PERIOD].any() and known[PERIOD : 2 * PERIOD].any())


def left_out(y: np.ndarray) -> list[str]:
    """Seasons that a series cannot have."""
    if not two_years(y):
        return ["A", "M"]
    return ["M"] if np.nanmin(y) <= 0 else []


#: Series that are searched side by side.
TOGETHER = 128


def search_many(series: list[np.ndarray], grid: pd.DataFrame) -> list[tuple]:
    """The best candidate of each series: its number, last state, squared error and AICc.

    Arrays are (series, candidate); a series takes part from the month after its start to its last one.
    """
    season, trended = grid["season"].to_numpy(), (grid["trend"] != "N").to_numpy()
    product = np.flatnonzero(season == "M")
    if product.size and product.size == product[-1] - product[0] + 1:
        product = slice(product[0], product[-1] + 1)
    alpha, beta, gamma, phi = grid[["alpha", "beta", "gamma", "phi"]].to_numpy().T
    # Start values depend on the form alone.
    _, example, of = np.unique([f"{t}{s}" for t, s in zip(trended, season)], return_index=True, return_inverse=True)
    starts = [start_values(y, trended[example], season[example]) for y in series]
    used = np.array([start[0] for start in starts])
    level, slope = (np.ascontiguousarray(np.stack([start[i] for start in starts])[:, of]) for i in (1, 2))
    # (calendar month, series, candidate)
    terms = np.ascontiguousarray(np.stack([start[3] for start in starts], axis=1)[:, :, of])
    size = np.array([len(y) for y in series])
    values = np.full((len(series), size.max()), np.nan)
    for row, y in zip(values, series):
        row[: len(y)] = y
    sse = np.zeros(level.shape)
    with np.errstate(all="ignore"):
        for month in range(int(used.min()), values.shape[1]):
            going = np.flatnonzero((month >= used) & (month < size))
            if going.size == len(series):
                going = slice(None)  # a view instead of a copy
            y = values[going, month][:, None]
            known = ~np.isnan(y)
            line, term = level[going] + phi * slope[going], terms[month % PERIOD, going]
            expected = line + term
            expected[:, product] = line[:, product] * term[:, product]
            error = y - expected
            error[~known[:, 0]] = 0.0
            pull, turn = error.copy(), error.copy()
            pull[:, product] /= term[:, product]
            turn[:, product] /= line[:, product]
            if not known.all():
                pull[~known[:, 0]] = turn[~known[:, 0]] = 0.0
            level[going], slope[going] = line + alpha * pull, phi * slope[going] + beta * pull
            terms[month % PERIOD, going] = term + gamma * turn
            sse[going] += error * error
        n = np.array([[(~np.isnan(y[first:])).sum()] for y, first in zip(series, used)])
        k = grid["k"].to_numpy()
        fit = n * np.log(np.maximum(sse, 1e-12) / np.maximum(n, 1)) + 2 * k
        aicc = np.where(n - k - 1 > 0, fit + 2 * k * (k + 1) / (n - k - 1), np.inf)
    allowed = np.array([~np.isin(season, left_out(y)) for y in series])
    # Among candidates that the series may have, the first one if none has a finite score.
    order = np.where(np.isfinite(sse) & allowed, aicc, np.inf)
    best = [int(np.argmin(o)) if np.isfinite(o).any() else int(np.argmax(a)) for o, a in zip(order, allowed)]
    found = []
    for i, b in enumerate(best):
        ahead = np.roll(terms[:, i, b], -(int(size[i]) % PERIOD))
        found.append((int(grid["grid_id"].iloc[b]), level[i, b], slope[i, b], ahead, sse[i, b], aicc[i, b]))
    return found


def search(y: np.ndarray, grid: pd.DataFrame) -> tuple:
    """The best candidate of one series; see ``search_many``."""
    return search_many([y], grid)[0]


def one_step(y: np.ndarray, candidate) -> list[float | None]:
    """What a candidate expected of each month from the months before; none for those the start used up."""
    times, alpha, beta, gamma, phi = candidate.season == "M", candidate.alpha, candidate.beta, candidate.gamma, candidate.phi
    used, levels, slopes, terms = start_values(
        y, np.array([candidate.trend != "N"]), np.array([candidate.season], dtype=object)
    )
    level, slope, terms, values = float(levels[0]), float(slopes[0]), terms[:, 0].tolist(), y.tolist()
    expected: list[float | None] = [None] * used
    for month in range(used, len(y)):
        line, term = level + phi * slope, terms[month % PERIOD]
        expected.append(line * term if times else line + term)
        level, slope = line, phi * slope
        error = values[month] - expected[-1]
        if error == error:  # a missing month leaves no error
            pull = error / term if times else error
            level, slope = level + alpha * pull, slope + beta * pull
            terms[month % PERIOD] = term + gamma * (error / line if times else error)
    return expected


FITTED = StructType(
    [
        StructField("grid_id", IntegerType()),
        StructField("form", StringType()),
        StructField("season", StringType()),
        *[StructField(c, DoubleType()) for c in ("alpha", "beta", "gamma", "phi")],
        *[StructField(c, DoubleType()) for c in ("level", "slope")],
        StructField("season_terms", ArrayType(DoubleType())),
        *[StructField(c, DoubleType()) for c in ("sse", "aicc", "variance")],
        StructField("left_out", ArrayType(StringType())),
        StructField("one_step", ArrayType(DoubleType())),
    ]
)


def fit(panel: DataFrame, grid: pd.DataFrame | None = None) -> DataFrame:
    """One row per series: the chosen form and weights, its last state and its corrected AIC.

    ``season_terms`` starts with the term of the first month after the series, ``one_step`` holds what was
    expected of each month, and ``variance`` is that of its errors.
    """
    grid = candidates() if grid is None else grid
    chosen = {c.grid_id: c for c in grid.itertuples(index=False)}

    @F.pandas_udf(FITTED)
    def best(series: pd.Series) -> pd.DataFrame:
        rows = []
        every = [np.asarray(values, dtype=float) for values in series]
        parts = [every[i : i + TOGETHER] for i in range(0, len(every), TOGETHER)]
        found = [one for part in parts for one in search_many(part, grid)]
        for y, (number, level, slope, terms, sse, aicc) in zip(every, found):
            c = chosen[number]
            form = f"ETS(A,{c.trend},{c.season})"
            weights = (c.alpha, c.beta, c.gamma, c.phi)
            expected = one_step(y, c)
            scored = sum(e is not None and not np.isnan(v) for e, v in zip(expected, y))
            state = (level, slope, terms, sse, aicc, sse / max(scored, 1))
            rows.append((number, form, c.season, *weights, *state, left_out(y), expected))
        return pd.DataFrame(rows, columns=FITTED.fieldNames())

    length = F.size(F.filter("ys", lambda y: y.isNotNull())).alias("n_obs")
    fitted = pack_series(panel).select("series_id", "last", length, best("ys").alias("best"))
    return fitted.select("series_id", "last", "n_obs", "best.*")


def _reach(steps: Column) -> Column:
    """``phi + phi^2 + ... + phi^steps``."""
    phi = F.col("phi")
    damped = F.try_divide(phi * (1 - F.pow(phi, steps)), 1 - phi)
    return F.when(phi == 1.0, steps.cast("double")).otherwise(damped)


def _spread(ahead: Column) -> Column:
    """Standard deviation of a month around its prediction; missing for the multiplicative season.

    An error moves the prediction ``j`` months later by ``alpha + beta (phi + ... + phi^j)``, and by ``gamma``
    more in the same calendar month.
    """

    def moved(j: Column) -> Column:
        yearly = F.when((F.col("season") == "A") & (j % PERIOD == 0), F.col("gamma")).otherwise(0.0)
        return F.when(j == 0, 1.0).otherwise(F.col("alpha") + F.col("beta") * _reach(j) + yearly)

    responses = F.transform(F.sequence(F.lit(0), ahead - 1), moved)
    squares = F.aggregate(responses, F.lit(0.0), lambda acc, c: acc + c * c)
    return F.when(F.col("season") != "M", F.sqrt(F.col("variance") * squares))


def predict(fitted: DataFrame, dates: DataFrame, *kept: str, spread: bool = False) -> DataFrame:
    """``(series_id, ds, value)`` for rows ``(series_id, ds)`` after the last fitted month, ``spread`` if asked.

    Columns of ``dates`` that are to be ``kept`` stand before the value.
    """
    rows = dates.select("series_id", "ds", *kept).join(fitted, "series_id").filter(F.col("ds") > F.col("last"))
    ahead = F.months_between("ds", "last").cast("int")
    line = F.col("level") + _reach(ahead) * F.col("slope")
    term = F.get("season_terms", F.pmod(ahead - 1, F.lit(PERIOD)))
    value = F.when(F.col("season") == "M", line * term).otherwise(line + term)
    more = [_spread(ahead).alias("spread")] if spread else []
    return rows.select("series_id", "ds", *kept, value.alias("value"), *more)


def in_sample(fitted: DataFrame, panel: DataFrame) -> DataFrame:
    """``(series_id, ds, value)``: what was expected of each fitted month that the panel has."""
    rows = fitted.select("series_id", "last", F.size("one_step").alias("n"), F.posexplode("one_step").alias("at", "value"))
    ds = F.add_months("last", F.col("at") - F.col("n") + 1).alias("ds")
    rows = rows.filter(F.col("value").isNotNull()).select("series_id", ds, "value")
    return rows.join(panel.select("series_id", "ds"), ["series_id", "ds"], "left_semi")
