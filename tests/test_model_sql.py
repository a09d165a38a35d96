"""The three models against their SQL on series that call for every kind of form."""

import math
from datetime import date

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidecast.operators import evaluate, split
from tidecast.plans import oracle


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(5)
    wave = [math.sin(i * math.pi / 6) for i in range(84)]
    level = np.cumsum(rng.standard_normal(84)) * 4 + 150
    return {
        "walk": level,
        "slope": [100 + 3 * i + rng.standard_normal() for i in range(84)],
        "season": [100 + 40 * w + rng.standard_normal() for w in wave],
        "growing season": [(50 + 3 * i) * (1 + 0.3 * w) + rng.standard_normal() for i, w in enumerate(wave)],
        "bent": [100 + 2 * min(i, 40) - 3 * max(i - 40, 0) + rng.standard_normal() for i in range(84)],
        "quick": [100 + 5 * (-1) ** i + rng.standard_normal() for i in range(84)],
        "drifting season": [v + 30 * w for v, w in zip(level, wave)],
        "crossing zero": [5 * w + rng.standard_normal() for w in wave],
        "three years": [80 + 20 * w + rng.standard_normal() for w in wave[:40]],
    }


@pytest.fixture(scope="module")
def fitted(spark, series):
    rows = [
        (name, date(2010 + i // 12, i % 12 + 1, 1), float(y))
        for name, values in series.items()
        for i, y in enumerate(values)
    ]
    panel = spark.createDataFrame(rows, "series_id string, ds date, y double")
    models = evaluate.fit_models(panel)
    ahead = split.future_frame(panel, 18)
    predicted = evaluate.predict_models(models, ahead).toPandas()
    forms = evaluate.model_table(models).select("series_id", "model_desc", "form").toPandas()

    connection = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["series_id", "ds", "y"])
    frame["ds"] = pd.to_datetime(frame["ds"])
    connection.register("frame", frame)
    connection.execute("CREATE TABLE panel AS SELECT series_id, CAST(ds AS DATE) AS ds, y FROM frame")
    sql = oracle.all_models("panel", oracle.future("panel", 18), "t", 18)
    expected = connection.execute(f"WITH RECURSIVE {sql} SELECT * FROM predicted_t").df()
    return predicted, expected, forms


@pytest.mark.parametrize("model", ["ARIMA", "PROPHET", "ETS"])
def test_predictions_equal_sql(fitted, model):
    predicted, expected, _ = fitted
    keys = ["series_id", "ds"]
    for frame in (predicted, expected):
        frame["ds"] = pd.to_datetime(frame["ds"])
    both = predicted[predicted.model_desc == model].merge(
        expected[expected.model_desc == model], on=keys, how="outer", suffixes=("", "_sql")
    )
    assert len(both) == 9 * 18
    wrong = both[~np.isclose(both["value"], both["value_sql"], rtol=1e-7, atol=1e-6)]
    assert wrong.empty, wrong.head()


def test_series_call_for_different_forms(fitted):
    _, _, forms = fitted
    ets = forms[forms.model_desc == "ETS"].set_index("series_id")["form"]
    assert ets["walk"].startswith("ETS(A,N,N)")
    assert ets["season"].endswith(",A)") or ets["season"].endswith(",M)")
    assert ets["growing season"].endswith(",M)")
    assert not ets["slope"].startswith("ETS(A,N")
    arima = forms[forms.model_desc == "ARIMA"].set_index("series_id")["form"]
    assert ",1," in arima["walk"].split(")")[0]
    assert arima["season"].split("(")[2].split(",")[1] == "1"


def test_intervals_and_fitted_values_equal_sql(spark, series):
    rows = [
        (name, date(2010 + i // 12, i % 12 + 1, 1), float(y))
        for name, values in series.items()
        for i, y in enumerate(values)
        if not (name == "bent" and i in (30, 50))
    ]
    panel = spark.createDataFrame(rows, "series_id string, ds date, y double")
    models = evaluate.fit_models(panel)
    found = evaluate.model_intervals(models, split.future_frame(panel, 18)).toPandas()
    fitted = evaluate.fitted_values(models, panel).toPandas()
    connection = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["series_id", "ds", "y"])
    frame["ds"] = pd.to_datetime(frame["ds"])
    connection.register("frame", frame)
    connection.execute("CREATE VIEW panel AS SELECT series_id, CAST(ds AS DATE) AS ds, y FROM frame")
    future = oracle.future("panel", 18)
    sql = oracle.all_models("panel", future, "t", 18)
    spreads = [oracle.arima_spread("arimat", 18), oracle.trend_spread("trendt", future), oracle.ets_spread("etst", 18)]
    parts = " UNION ALL ".join(f"SELECT {i + 1} AS model_id, * FROM spread_{t}t" for i, t in enumerate(("arima", "trend", "ets")))
    expected = connection.execute(f"WITH RECURSIVE {sql}, {', '.join(spreads)} {parts}").df()
    found["ds"] = pd.to_datetime(found["ds"])
    both = found.merge(expected, on=["series_id", "model_id", "ds"], how="outer")
    assert len(both) == 9 * 18 * 3
    half = (both["conf_hi"] - both["conf_lo"]) / 2
    z = 1.959963984540054
    assert np.allclose(half, z * both["spread"], rtol=1e-6, atol=1e-6, equal_nan=True)
    assert (both["closed"] == both["spread"].notna()).all() and not both["closed"].all()
    widths = both.assign(half=half)[both["closed"]].sort_values("ds").groupby(["series_id", "model_id"])["half"]
    assert widths.apply(lambda w: (np.diff(w) >= -1e-9).all()).all()
    assert {(r.series_id, r.model_desc) for r in fitted.itertuples()} == {(n, m) for n in series for m in ("ARIMA", "PROPHET", "ETS")}
    fitted["ds"] = pd.to_datetime(fitted["ds"])
    beside = fitted.merge(frame, on=["series_id", "ds"])
    assert len(beside) == len(fitted)
    error = (beside["y"] - beside["value"]).abs().groupby(beside["model_desc"]).median()
    assert (error < 8).all(), error
