import math
from datetime import date

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidecast.operators import autoregression, evaluate, forecast, smoothing, split, trend_season


def month_days(n):
    return np.array([(date(2010 + i // 12, i % 12 + 1, 1) - date(1970, 1, 1)).days for i in range(n)])


def test_trend_season_recovers_a_line_with_a_wave(monthly):
    days = month_days(60)
    t = (days - days[0]) / (days[-1] - days[0])
    y = 50 + 30 * t + 8 * np.sin(2 * np.pi * days / 365.25)
    panel = monthly({"a": y})
    fitted = trend_season.fit(panel)
    found = trend_season.predict(fitted, panel).orderBy("ds").collect()
    assert np.max(np.abs(np.array([r.value for r in found]) - y)) < 0.2


def objective(beta, x, y, noise):
    """Negative log posterior of the published model, up to a constant."""
    error = y - x @ beta
    waves = 2 * trend_season.SEASON_ORDER
    bends = beta[2:-waves]
    return (
        len(y) * math.log(noise)
        + error @ error / (2 * noise**2)
        + noise**2 / (2 * trend_season.NOISE_SCALE**2)
        + np.abs(bends).sum() / trend_season.CHANGEPOINT_SCALE
        + beta[:2] @ beta[:2] / (2 * trend_season.TREND_SCALE**2)
        + beta[-waves:] @ beta[-waves:] / (2 * trend_season.SEASON_SCALE**2)
    )


@pytest.mark.parametrize("seed", range(3))
def test_posterior_mode_has_no_better_neighbour(seed):
    rng = np.random.default_rng(seed)
    days = month_days(72)
    t = (days - days[0]) / (days[-1] - days[0])
    hinges = [np.maximum(t - 0.8 * j / 25, 0) for j in range(1, 26)]
    angles = 2 * np.pi * days / 365.25
    waves = [f(angles * k) for k in range(1, 11) for f in (np.sin, np.cos)]
    x = np.column_stack([np.ones(72), t, *hinges, *waves])
    y = 0.5 + 0.3 * t - 0.5 * np.maximum(t - 0.4, 0) + 0.05 * rng.standard_normal(72)
    beta, steps, converged = trend_season.posterior_mode(x.T @ x, x.T @ y, y @ y, 72)
    assert converged and steps < 200
    sse = float(np.sum((y - x @ beta) ** 2))
    noise = math.sqrt((math.sqrt(72**2 + 16 * sse) - 72) / 8)
    best = objective(beta, x, y, noise)
    for _ in range(300):
        step = rng.standard_normal(len(beta)) * 10.0 ** rng.integers(-5, 0)
        assert objective(beta + step, x, y, noise) > best - 1e-3
        only = np.zeros(len(beta))
        place = rng.integers(len(beta))
        only[place] = step[place]
        assert objective(beta + only, x, y, noise) > best - 1e-3
    assert objective(beta, x, y, noise * 1.01) > best
    assert objective(beta, x, y, noise * 0.99) > best


def test_trend_season_on_short_and_constant_series(monthly):
    panel = monthly({"one": [3], "flat": [0] * 24, "two": [3, 4]})
    fitted = trend_season.fit(panel)
    found = trend_season.predict(fitted, split.future_frame(panel, 2)).collect()
    assert len(found) == 6 and all(math.isfinite(r.value) for r in found)
    assert all(abs(r.value) < 1e-6 for r in found if r.series_id == "flat")


def fold_by_hand(y, trend, season, alpha, beta, gamma, phi):
    """Plain smoothing recursion from the start values of a two-year series."""
    first, second = np.mean(y[:12]), np.mean(y[12:24])
    slope = 0.0 if trend == "N" else (second - first) / 12
    level = first + 5.5 * slope
    terms = []
    for i in range(12):
        line = first + (i - 5.5) * slope
        terms.append({"N": 0.0, "A": y[i] - line, "M": y[i] / line}[season])
    sse = 0.0
    for i in range(12, len(y)):
        line, term = level + phi * slope, terms[i % 12]
        error = y[i] - (line * term if season == "M" else line + term)
        pull = error / term if season == "M" else error
        level, slope = line + alpha * pull, phi * slope + beta * pull
        terms[i % 12] = term + gamma * (error / line if season == "M" else error)
        sse += error * error
    return sse


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(50, 150), min_size=26, max_size=60))
def test_search_finds_the_smallest_aicc(values):
    y, grid = np.array(values), smoothing.candidates()
    number, *_, sse, aicc = smoothing.search(y, grid)
    n, scores = len(y) - 12, {}
    for c in grid.itertuples():
        error = fold_by_hand(y, c.trend, c.season, c.alpha, c.beta, c.gamma, c.phi)
        room = n - c.k - 1
        fit = n * math.log(max(error, 1e-12) / n) + 2 * c.k
        score = fit + 2 * c.k * (c.k + 1) / room if room > 0 else math.inf
        scores[c.grid_id] = (score, error)
    assert scores[number][0] == pytest.approx(min(s for s, _ in scores.values()), abs=1e-6)
    assert sse == pytest.approx(scores[number][1], rel=1e-9)


def test_smoothing_continues_a_trend_with_a_season(monthly):
    panel = monthly({"a": [100 + i + 10 * (i % 12) for i in range(48)]})
    fitted = smoothing.fit(panel)
    row = fitted.first()
    assert row.sse == pytest.approx(0, abs=1e-9)
    ahead = smoothing.predict(fitted, split.future_frame(panel, 14)).orderBy("ds").collect()
    expected = [100 + i + 10 * (i % 12) for i in range(48, 62)]
    assert [r.value for r in ahead] == pytest.approx(expected, abs=1e-6)


def test_smoothing_of_short_series_uses_the_level(monthly):
    panel = monthly({"short": [5, 6, 5, 7, 5, 6, 5, 6, 5, 6], "one": [4], "zero": [0] * 30})
    forms = {r.series_id: r for r in smoothing.fit(panel).collect()}
    assert forms["short"].season == "N"
    assert forms["one"].form == "ETS(A,N,N)" and forms["one"].level == 4
    assert forms["zero"].season != "M"
    ahead = smoothing.predict(smoothing.fit(panel), split.future_frame(panel, 3)).collect()
    assert len(ahead) == 9


def test_autoregression_recovers_its_coefficient(monthly):
    rng = np.random.default_rng(7)
    y = [0.0]
    for _ in range(600):
        y.append(0.7 * y[-1] + rng.standard_normal())
    row = autoregression.fit(monthly({"a": [100 + v for v in y]})).first()
    assert row.d == 0 and row.seasonal_d == 0
    # The response to a shock one month back, whichever order was chosen.
    assert row.weights[0] + row.theta[0] == pytest.approx(0.7, abs=0.1)


def test_differencing_follows_trend_and_season(monthly):
    rng = np.random.default_rng(1)
    walk = np.cumsum(rng.standard_normal(120)) * 5 + 100
    season = [100 + 30 * math.sin(i * math.pi / 6) + rng.standard_normal() for i in range(120)]
    noise = 100 + rng.standard_normal(120)
    panel = monthly({"walk": walk, "season": season, "noise": noise})
    found = {r.series_id: (r.d, r.seasonal_d) for r in autoregression.differencing_orders(panel).collect()}
    assert found["walk"] == (1, 0)
    assert found["season"][1] == 1
    assert found["noise"] == (0, 0)


def test_weights_undo_the_differences():
    phi = np.zeros(12)
    phi[0] = 0.5
    weights = autoregression.level_weights(phi, 1, 1)
    y = np.random.default_rng(3).standard_normal(40)
    w = np.diff(y)[12:] - np.diff(y)[:-12]
    ahead = 0.5 * w[-1]
    rebuilt = sum(a * v for a, v in zip(weights, y[::-1]))
    assert rebuilt == pytest.approx(ahead + y[-1] + y[-12] - y[-13])


def test_arima_repeats_an_exact_season(monthly):
    y = [100 + 10 * (i % 12) for i in range(72)]
    panel = monthly({"a": y, "tiny": [3, 4, 5]})
    fitted = autoregression.fit(panel)
    ahead = autoregression.predict(fitted, split.future_frame(panel, 13)).orderBy("ds").collect()
    values = [r.value for r in ahead if r.series_id == "a"]
    assert values == pytest.approx([100 + 10 * (i % 12) for i in range(72, 85)], abs=1e-6)
    assert len([r for r in ahead if r.series_id == "tiny"]) == 13


@pytest.fixture
def seasonal(monthly):
    rng = np.random.default_rng(11)
    wave = [200 + i + 20 * math.sin(i * math.pi / 6) for i in range(72)]
    return monthly({name: [v + rng.standard_normal() for v in wave] for name in "ab"})


def test_calibration_accuracy_and_intervals(seasonal):
    parts = split.split_by_duration(seasonal)
    models = evaluate.fit_models(split.training(parts))
    calibration = evaluate.calibrate(models, split.testing(parts))
    assert calibration.count() == 2 * 3 * 12
    assert evaluate.calibration_of(calibration, "ETS").count() == 24
    scores = evaluate.accuracy(calibration).collect()
    assert len(scores) == 6 and all(r.mape < 5 for r in scores)
    table = forecast.forecast_with_actuals(
        forecast.forecast_future(forecast.refit(seasonal), seasonal, 42), seasonal, calibration
    )
    counts = {r.key: r["count"] for r in table.groupBy("key").count().collect()}
    assert counts == {"actual": 144, "prediction": 2 * 3 * 42}
    outside = table.filter("key = 'prediction'").filter(
        ~((F.col("conf_lo") <= F.col("value")) & (F.col("value") <= F.col("conf_hi")))
    )
    assert outside.count() == 0
    rolled = forecast.forecast_rollup(table)
    assert rolled.count() == 84 and rolled.columns == ["mes_ano", "ano", "total", "tipo", "regiao"]
    table_of_models = evaluate.model_table(models).collect()
    found = sorted({(r.model_id, r.model_desc) for r in table_of_models})
    assert found == [(1, "ARIMA"), (2, "PROPHET"), (3, "ETS")]


def test_thirteen_held_out_months_and_twelve_predicted(monthly):
    panel = monthly({"a": [100 + i for i in range(37)]})
    parts = split.split_by_date(panel, "2012-01-01")
    train, test = split.training(parts), split.testing(parts)
    assert (train.count(), test.count()) == (24, 13)
    models = evaluate.fit_models(train, "ETS")
    predicted = evaluate.predict_models(models, split.future_frame(train, 12))
    compared = evaluate.forecast_vs_observed(predicted, test, F.lit("2012-01-01").cast("date"))
    assert compared.count() == 12 and compared.filter("y IS NULL").count() == 0
    assert evaluate.mae_mape(compared).count() == 1


def test_in_sample_values_cover_the_history(seasonal):
    models = evaluate.fit_models(seasonal, "PROPHET")
    fitted = forecast.in_sample(models, seasonal).join(seasonal, ["series_id", "ds"])
    assert fitted.count() == 144
    assert fitted.agg(F.max(F.abs(F.col("value") - F.col("y")))).first()[0] < 20


def test_series_searched_together_are_found_as_one_by_one():
    rng = np.random.default_rng(5)
    series = [rng.normal(size=n).cumsum() * size for n in (1, 9, 30, 35, 36, 80) for size in (1e-2, 1.0, 1e4)]
    series += [np.full(50, 3.0), np.full(4, np.nan), np.where(rng.random(60) < 0.3, np.nan, rng.normal(size=60))]
    differences = [i % 3 for i in range(len(series))]
    together = autoregression.choose_orders(series, differences)
    for w, d, found in zip(series, differences, together):
        alone = autoregression.choose_order(w, d)
        assert [found[key] for key in ("p", "q", "seasonal_p")] == [alone[key] for key in ("p", "q", "seasonal_p")]
        assert np.allclose(found["phi"], alone["phi"]) and np.allclose(found["theta"], alone["theta"])
        assert found["aicc"] == pytest.approx(alone["aicc"])
        known = [r for r in found["residuals"] if r is not None]
        assert found["sse"] == pytest.approx(sum(r * r for r in known))
