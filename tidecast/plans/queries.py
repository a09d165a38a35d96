"""Registered queries: each takes a session and a table directory and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidecast.functions.dates import (
    date_literal,
    month_start,
    month_year,
    month_year_strict,
    text_between,
)
from tidecast.functions.labels import canonical_label, ordered_codes
from tidecast.functions.numbers import as_number, strict_sum
from tidecast.operators import (
    autoregression,
    capacity,
    evaluate,
    forecast,
    reshape,
    smoothing,
    trend_season,
)
from tidecast.operators import panel as panels
from tidecast.operators import split as splits
from tidecast.plans import bindings as b
from tidecast.session import scratch_path, stage
from tidecast.sources import (
    clean_names,
    literal_table,
    read_export_csv,
    read_sheet,
    schemas,
    sql_extract,
    write_export_csv,
    write_table,
)

Query = Callable[[SparkSession, str], DataFrame]

HORIZON = 42
CUT = "2000-07-01"
SHORT_HORIZON = 12
# Supply counts from the year after this one.
LAST_PAST_YEAR = 1997
DECIMALS = 6


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, for comparison with results added up in another order."""
    doubles = [f.name for f in df.schema.fields if f.dataType == DoubleType()]
    return df.withColumns({c: F.round(F.col(f"`{c}`"), DECIMALS) for c in doubles})


# --- sources, projections, filters, joins, aggregates ------------------------------------------

MONTH_COUNT = """
    SELECT IDENTIFIER(:code) AS code, date_format(IDENTIFIER(:date), 'MMyyyy') AS mes_ano, count(*) AS total
    FROM {records}
    WHERE IDENTIFIER(:code) = :value
    GROUP BY ALL
"""
PRIORITY_COUNT = """
    WITH named AS (SELECT substring(o_orderpriority FROM 3) AS priority, year(o_orderdate) AS ano FROM {orders})
    SELECT priority, ano, count(*) AS total FROM named WHERE priority <> :left_out GROUP BY ALL
"""


def _extract(spark: SparkSession, records: DataFrame, code: str, date: str, value: str):
    bound = {"code": code, "date": date, "value": value}
    return sql_extract(spark, MONTH_COUNT, bound, records=records)


def month_count_sql(spark, sf_dir):
    orders = b.table(spark, sf_dir, "orders")
    return _extract(spark, orders, "o_orderpriority", "o_orderdate", "1-URGENT")


def priority_count_sql(spark, sf_dir):
    """Orders per year and name of the priority, which is part of a text column."""
    orders = b.table(spark, sf_dir, "orders")
    return sql_extract(spark, PRIORITY_COUNT, {"left_out": "NOT SPECIFIED"}, orders=orders)


def month_series_by_region(spark, sf_dir):
    return b.panel(spark, sf_dir).withColumn("status", F.lit("atual"))


def month_series_from_text(spark, sf_dir):
    """The panel from pre-counted text records: day-month-year strings, codes with a check digit."""
    counted = (
        b.table(spark, sf_dir, "orders")
        .groupBy("o_custkey", F.date_format("o_orderdate", "ddMMyyyy").alias("dtnasc"))
        .agg(F.count(F.lit(1)).alias("contagem"))
    )
    customers = b.table(spark, sf_dir, "customer").select(
        "c_custkey", F.format_string("%06d%d", "c_nationkey", F.lit(7)).alias("codmunres")
    )
    births = counted.join(customers, counted.o_custkey == customers.c_custkey)
    dated = births.withColumns(
        {
            "data": month_year(text_between("dtnasc", 3, 8)),
            "codmunres6": as_number(text_between("codmunres", 1, 6)),
        }
    )
    kept = dated.filter(F.col("data") < date_literal(b.CUTOFF))
    nations = b.table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("double").alias("cod_municipio"), "n_name"
    )
    return panels.month_series(
        kept, "codmunres6", F.col("data"), nations, "cod_municipio", "n_name", value="contagem"
    )


def code_prefix_join(spark, sf_dir):
    coded = b.table(spark, sf_dir, "customer").select(
        F.format_string("%06d%d", "c_nationkey", F.lit(7)).alias("codmunres"), "c_acctbal"
    )
    numbered = coded.withColumn("codmunres6", as_number(text_between("codmunres", 1, 6)))
    per_code = numbered.groupBy("codmunres6").agg(
        F.count(F.lit(1)).alias("n"), strict_sum("c_acctbal").alias("total")
    )
    nations = b.table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("double").alias("cod_municipio"), "n_name"
    )
    joined = per_code.join(nations, per_code.codmunres6 == nations.cod_municipio, "left")
    return joined.select("n_name", "codmunres6", "n", F.round("total", 2).alias("total"))


def two_hop_join(spark, sf_dir):
    """Monthly order totals per nation, reached from the order over the customer."""
    orders = b.table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
    customers, nations = b.table(spark, sf_dir, "customer"), b.table(spark, sf_dir, "nation")
    named = customers.join(nations, customers.c_nationkey == nations.n_nationkey, "left")
    placed = orders.join(named, orders.o_custkey == named.c_custkey, "left")
    totals = panels.month_totals(placed, ["n_name"], month_start("o_orderdate"))
    return totals.withColumnRenamed("y", "total")


def distinct_periods(spark, sf_dir):
    return panels.periods(b.panel(spark, sf_dir))


def region_slice(spark, sf_dir):
    return panels.slice_series(b.panel(spark, sf_dir), "ASIA")


def _extracts(spark, sf_dir):
    """Month counts from three tables of records, stacked and dated."""
    parts = [
        ("orders", "o_orderstatus", "o_orderdate", "F"),
        ("lineitem", "l_returnflag", "l_shipdate", "R"),
        ("events", "event_type", "ts", "click"),
    ]
    counts = [
        _extract(spark, b.table(spark, sf_dir, name), code, date, value)
        for name, code, date, value in parts
    ]
    stacked = counts[0].unionByName(counts[1]).unionByName(counts[2])
    return stacked.withColumn("mes_ano", month_year_strict("mes_ano"))


def union_extracts(spark, sf_dir):
    return _extracts(spark, sf_dir).filter(F.col("mes_ano") < date_literal("2001-10-01"))


def first_months(spark, sf_dir):
    return panels.first_rows(_extracts(spark, sf_dir), ["mes_ano", "code"])


def frame_profile(spark, sf_dir):
    return panels.frame_profile(b.table(spark, sf_dir, "orders"))


def clean_names_scan(spark, sf_dir):
    """Customers under untidy headers, tidied."""
    customers = b.table(spark, sf_dir, "customer")
    messy = customers.toDF("C CustKey", "Nome (cliente)", "NationKey", "Saldo %", "Saldo_%")
    return clean_names(messy).select("c_cust_key", "nation_key", "saldo_percent", "saldo_percent_2")


def category_codes(spark, sf_dir):
    levels = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    coded = b.table(spark, sf_dir, "orders").withColumn(
        "id", ordered_codes("o_orderpriority", levels)
    )
    return panels.row_counts(coded, "o_orderpriority", "id")


def _gapped(orders, customers):
    """Orders per customers' nation, order priority and month; months without an order are missing."""
    placed = orders.join(customers, orders.o_custkey == customers.c_custkey)
    name = F.concat_ws("/", "c_nationkey", "o_orderpriority").alias("series_id")
    return panels.month_totals(placed, [name], month_start("o_orderdate"))


def complete_months(spark, sf_dir):
    """Customers' nations and order priorities as series, with every month of each present."""
    orders = b.table(spark, sf_dir, "orders")
    customers = b.table(spark, sf_dir, "customer")
    return panels.complete_months(_gapped(orders, customers), fill=0.0)


# --- splits and frames -------------------------------------------------------------------------


def split_by_duration(spark, sf_dir):
    return splits.split_by_duration(b.panel(spark, sf_dir))


def split_by_date(spark, sf_dir):
    return splits.split_by_date(b.panel(spark, sf_dir), CUT)


def split_plan(spark, sf_dir):
    return splits.split_plan(splits.split_by_duration(b.panel(spark, sf_dir)))


def future_frame(spark, sf_dir):
    return splits.future_frame(b.panel(spark, sf_dir), HORIZON)


def total_series(spark, sf_dir):
    return b.scopes(spark, sf_dir)


# --- models ------------------------------------------------------------------------------------


def _train_test(spark, sf_dir):
    """Training and testing months, split once for all models."""
    panel = panels.with_total_series(b.panel(spark, sf_dir))
    split = stage(splits.split_by_duration(panel))
    return splits.training(split), splits.testing(split)


def _calibration(spark, sf_dir, *descs):
    train, test = _train_test(spark, sf_dir)
    return evaluate.calibrate(evaluate.fit_models(train, *descs), test)


def _fitted(spark, sf_dir, desc):
    train, _ = _train_test(spark, sf_dir)
    return evaluate.fit_models(train, desc)[0][1]


def trend_season_design(spark, sf_dir):
    """Design rows of the trend and season model, one row per regressor."""
    rows = trend_season.design(b.scopes(spark, sf_dir))
    return rounded(rows.select("series_id", "ds", F.posexplode("x").alias("term", "value")))


def fit_trend_season(spark, sf_dir):
    """Coefficients of the trend and season model, one row per regressor."""
    fitted = _fitted(spark, sf_dir, "PROPHET")
    columns = ["series_id", "n_obs", "converged", F.posexplode("beta").alias("term", "value")]
    return rounded(fitted.select(*columns))


def fit_ets(spark, sf_dir):
    fitted = _fitted(spark, sf_dir, "ETS")
    columns = ["series_id", "n_obs", "grid_id", "form", "level", "slope", "sse", "aicc"]
    return rounded(fitted.select(*columns))


def fit_gapped(spark, sf_dir):
    """Exponential smoothing of customers' nations and order priorities, which lack months."""
    series = stage(_gapped(b.table(spark, sf_dir, "orders"), b.table(spark, sf_dir, "customer")))
    columns = ["series_id", "n_obs", "grid_id", "form", "level", "slope", "sse", "aicc"]
    return rounded(smoothing.fit(series).select(*columns))


def fit_arima(spark, sf_dir):
    fitted = _fitted(spark, sf_dir, "ARIMA")
    return rounded(fitted.select("series_id", "n_obs", "form", "offset", "sse", "aicc"))


def differencing_orders(spark, sf_dir):
    orders = autoregression.differencing_orders(b.scopes(spark, sf_dir))
    return rounded(orders.select("series_id", "n_obs", "strength", "kpss", "d", "seasonal_d"))


def model_table(spark, sf_dir):
    """All models of all series, one row per coefficient."""
    train, _ = _train_test(spark, sf_dir)
    table = evaluate.model_table(evaluate.fit_models(train))
    columns = ["series_id", "model_id", "model_desc", "form", "n_obs"]
    return rounded(table.select(*columns, F.posexplode("coefficients").alias("term", "value")))


def calibrate(spark, sf_dir):
    return rounded(_calibration(spark, sf_dir))


def calibrate_ets(spark, sf_dir):
    return rounded(_calibration(spark, sf_dir, "ETS"))


def calibration_of(spark, sf_dir):
    return rounded(evaluate.calibration_of(_calibration(spark, sf_dir), "PROPHET"))


def accuracy(spark, sf_dir):
    return rounded(evaluate.accuracy(_calibration(spark, sf_dir)))


def accuracy_ets(spark, sf_dir):
    return rounded(evaluate.accuracy(_calibration(spark, sf_dir, "ETS")))


def _forecast(spark, sf_dir, panel, *descs):
    return forecast.forecast_future(forecast.refit(panel, *descs), panel, HORIZON)


def refit_forecast(spark, sf_dir):
    return rounded(_forecast(spark, sf_dir, b.scopes(spark, sf_dir)))


def refit_forecast_ets(spark, sf_dir):
    return rounded(_forecast(spark, sf_dir, b.scopes(spark, sf_dir), "ETS"))


def _calibrated_forecast(spark, sf_dir, *descs):
    split = stage(splits.split_by_duration(panels.with_total_series(b.panel(spark, sf_dir))))
    panel = split.drop("split_key")
    models = evaluate.fit_models(splits.training(split), *descs)
    calibration = evaluate.calibrate(models, splits.testing(split))
    predictions = _forecast(spark, sf_dir, panel, *descs)
    return forecast.forecast_with_actuals(predictions, panel, calibration)


def forecast_with_actuals(spark, sf_dir):
    return rounded(_calibrated_forecast(spark, sf_dir))


def forecast_with_actuals_ets(spark, sf_dir):
    return rounded(_calibrated_forecast(spark, sf_dir, "ETS"))


def actual_rows(spark, sf_dir):
    """Chart slice of the forecast table: observed months after 1999."""
    table = _calibrated_forecast(spark, sf_dir, "ETS")
    shown = (F.col("model_desc") == "ACTUAL") & (F.col("index") > date_literal("1999-01-01"))
    return table.filter(shown).select("series_id", "key", "index", "value")


def forecast_intervals(spark, sf_dir):
    table = _calibrated_forecast(spark, sf_dir)
    return rounded(table.filter(F.col("key") == forecast.PREDICTION))


def holdout_forecast(spark, sf_dir):
    """Predictions of the held-out months by all models, with intervals, and the whole history."""
    split = stage(splits.split_by_duration(panels.with_total_series(b.panel(spark, sf_dir))))
    panel = split.drop("split_key")
    models, test = evaluate.fit_models(splits.training(split)), splits.testing(split)
    predicted = stage(evaluate.predict_models(models, test, "y"))
    calibration = evaluate.residuals(predicted)
    return rounded(forecast.forecast_with_actuals(predicted.drop("y"), panel, calibration))


def forecast_frame_80(spark, sf_dir):
    """Fixed cut: fitted months and the twelve after them with bounds at 80 percent."""
    split = splits.split_by_date(b.scopes(spark, sf_dir), CUT)
    train, test = splits.training(split), splits.testing(split)
    models = evaluate.fit_models(train, "PROPHET")
    framed = evaluate.predict_models(models, splits.future_frame(train, SHORT_HORIZON, history=True))
    ranged = evaluate.with_interval(framed, evaluate.calibrate(models, test), level=0.8)
    return rounded(
        ranged.select(
            "series_id",
            "ds",
            F.col("value").alias("yhat"),
            F.col("conf_lo").alias("yhat_lower"),
            F.col("conf_hi").alias("yhat_upper"),
        )
    )


def observed_and_forecast(spark, sf_dir):
    """Observed and predicted months under canonical region names."""
    panel = b.staged_panel(spark, sf_dir)
    table = forecast.forecast_with_actuals(_forecast(spark, sf_dir, panel, "PROPHET"), panel)
    ahead = forecast.combined([forecast.forecast_rollup(table)])
    return rounded(capacity.observed_and_forecast(ahead, panel, b.REGION_NAMES))


def in_sample_fit(spark, sf_dir):
    panel = splits.training(splits.split_by_date(b.scopes(spark, sf_dir), CUT))
    fitted = forecast.in_sample(evaluate.fit_models(panel, "PROPHET"), panel)
    return rounded(fitted.join(panel, ["series_id", "ds"]))


def fitted_values(spark, sf_dir):
    """What each model makes of the training months, beside the observed values."""
    train, _ = _train_test(spark, sf_dir)
    fitted = forecast.in_sample(evaluate.fit_models(train), train)
    return rounded(fitted.join(train, ["series_id", "ds"]))


def model_intervals(spark, sf_dir):
    """Forecast months of all models with intervals that widen with the months ahead."""
    panel = b.scopes(spark, sf_dir)
    return rounded(evaluate.model_intervals(forecast.refit(panel), splits.future_frame(panel, HORIZON)))


def _fixed_cut(spark, sf_dir, desc):
    """Fixed cut, thirteen held-out months, twelve forecast months joined to the observed ones."""
    split = splits.split_by_date(b.scopes(spark, sf_dir), CUT)
    train = splits.training(split)
    models = evaluate.fit_models(train, desc)
    predicted = evaluate.predict_models(models, splits.future_frame(train, SHORT_HORIZON))
    observed = splits.testing(split)
    return evaluate.forecast_vs_observed(predicted, observed, date_literal(CUT))


def forecast_vs_observed(spark, sf_dir):
    return rounded(_fixed_cut(spark, sf_dir, "PROPHET"))


def forecast_vs_observed_ets(spark, sf_dir):
    return rounded(_fixed_cut(spark, sf_dir, "ETS"))


def mae_mape(spark, sf_dir):
    return rounded(evaluate.mae_mape(_fixed_cut(spark, sf_dir, "PROPHET")))


def mae_mape_ets(spark, sf_dir):
    return rounded(evaluate.mae_mape(_fixed_cut(spark, sf_dir, "ETS")))


def _region_table(spark, sf_dir, desc):
    panel = b.staged_panel(spark, sf_dir)
    return forecast.forecast_with_actuals(_forecast(spark, sf_dir, panel, desc), panel)


def forecast_rollup(spark, sf_dir):
    return rounded(forecast.forecast_rollup(_region_table(spark, sf_dir, "PROPHET")))


def forecast_rollup_ets(spark, sf_dir):
    return rounded(forecast.forecast_rollup(_region_table(spark, sf_dir, "ETS"), "ETS"))


def actual_rollup(spark, sf_dir):
    panel = b.panel(spark, sf_dir)
    observed = panel.select(
        "series_id",
        F.lit(forecast.ACTUAL).alias("key"),
        F.col("ds").alias("index"),
        F.col("y").alias("value"),
    )
    return forecast.actual_rollup(observed, after="1997-01-01")


def _combined(spark, sf_dir, desc):
    table = _region_table(spark, sf_dir, desc)
    parts = [forecast.actual_rollup(table, "1997-01-01"), forecast.forecast_rollup(table, desc)]
    return forecast.combined(parts)


def forecast_combined(spark, sf_dir):
    return rounded(_combined(spark, sf_dir, "PROPHET"))


def forecast_combined_ets(spark, sf_dir):
    return rounded(_combined(spark, sf_dir, "ETS"))


def panel_row_counts(spark, sf_dir):
    panel = b.staged_panel(spark, sf_dir)
    table = forecast.forecast_with_actuals(_forecast(spark, sf_dir, panel, "PROPHET"), panel)
    ahead = forecast.combined([forecast.forecast_rollup(table)])
    both = capacity.observed_and_forecast(ahead, panel, b.REGION_NAMES)
    return panels.row_counts(both, "macrorregiao")


def canonical_labels(spark, sf_dir):
    """Panel months under a spelling that changes with the month, brought to one name."""
    name, turn = F.col("series_id"), F.month("ds") % 4
    spelled = (
        F.when(turn == 0, F.concat(F.lit("Macrorregião "), F.initcap(name)))
        .when(turn == 1, F.lower(F.translate(name, " ", "_")))
        .when(turn == 2, F.concat(F.lit(" macrorregi?o "), F.translate(name, " ", "-")))
        .otherwise(F.concat(F.lit("Norte "), name))
    )
    labelled = b.panel(spark, sf_dir).withColumn("rotulo", spelled)
    named = labelled.withColumn("macrorregiao", canonical_label("rotulo", b.REGION_NAMES))
    return named.groupBy("rotulo", "macrorregiao").agg(strict_sum("y").alias("total"))


# --- capacity gap ------------------------------------------------------------------------------


def procedure_times(spark, sf_dir):
    sheet = b.procedure_sheet(b.monthly_lines(spark, sf_dir))
    return rounded(capacity.procedure_times(sheet))


def procedure_rank(spark, sf_dir):
    sheet = b.procedure_sheet(b.monthly_lines(spark, sf_dir))
    return rounded(capacity.procedure_rank(capacity.procedure_times(sheet)))


def yearly_demand(spark, sf_dir):
    return capacity.yearly_demand(b.time_sheet(b.monthly_lines(spark, sf_dir)), b.FLAGS)


def demand_long(spark, sf_dir):
    return capacity.demand_long(yearly_demand(spark, sf_dir), b.FLAGS)


def supply_by_year(spark, sf_dir):
    lines = b.monthly_lines(spark, sf_dir, since=f"{LAST_PAST_YEAR + 1}-01-01")
    return capacity.supply_by_year(b.supply_sheet(lines), after=LAST_PAST_YEAR)


def _both_sides(spark, sf_dir, common_years=False):
    """Demand and supply from one pass over the lines, which both sides read.

    Only supply is bounded by year; demand has all its years.
    """
    lines = stage(b.monthly_lines(spark, sf_dir))
    demand = capacity.demand_long(capacity.yearly_demand(b.time_sheet(lines), b.FLAGS), b.FLAGS)
    supply = capacity.supply_by_year(b.supply_sheet(lines), after=LAST_PAST_YEAR)
    return capacity.demand_and_supply(supply, demand, common_years)


def demand_supply(spark, sf_dir):
    return _both_sides(spark, sf_dir)


def scenario_totals(spark, sf_dir):
    """Gap rows labelled by a table of scenarios written in code, totalled per label."""
    rows = list(capacity.SCENARIOS.items())
    labels = literal_table(spark, rows, "cenario string, status string")
    # As many rows as the code lists.
    named = _both_sides(spark, sf_dir).join(F.broadcast(labels), "cenario", "left")
    return named.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), strict_sum("total").alias("total")
    )


def gap_labels(spark, sf_dir):
    return capacity.gap_labels(_both_sides(spark, sf_dir))


def _deficit(spark, sf_dir, by_year=False, common_years=False):
    both = _both_sides(spark, sf_dir, common_years)
    return capacity.deficit(both, by_year=by_year, duplicates="sum")


def deficit(spark, sf_dir):
    return rounded(_deficit(spark, sf_dir))


def deficit_common_years(spark, sf_dir):
    """The gap over the years that have both demand and supply."""
    return rounded(_deficit(spark, sf_dir, common_years=True))


def deficit_unique_keys(spark, sf_dir):
    """The gap from supply without levels of care, where a key that repeats would be an error."""
    lines = stage(b.monthly_lines(spark, sf_dir))
    demand = capacity.demand_long(capacity.yearly_demand(b.time_sheet(lines), b.FLAGS), b.FLAGS)
    one_level = b.supply_sheet(lines).withColumn("nivel_atencao", F.lit("total"))
    supply = capacity.supply_by_year(one_level, after=LAST_PAST_YEAR)
    both = capacity.demand_and_supply(supply, demand, common_years=True)
    return rounded(capacity.deficit(both, by_year=True, duplicates="fail"))


def deficit_by_year(spark, sf_dir):
    return rounded(_deficit(spark, sf_dir, by_year=True))


def deficit_long(spark, sf_dir):
    return rounded(capacity.deficit_long(_deficit(spark, sf_dir)))


def workload(spark, sf_dir):
    shares = {
        "medico_ab": {"tempo_a": 0.5, "tempo_n": 1.0},
        "medico_esp": {"tempo_r": 1.0},
        "enf_ab": {"tempo_a": 0.5},
    }
    demand = yearly_demand(spark, sf_dir)
    return rounded(capacity.workload(demand, ["ano", "regiao"], shares))


# --- sinks -------------------------------------------------------------------------------------


def export_roundtrip(spark, sf_dir):
    """The rollup of observed months written as an export, read back with its row numbers."""
    rollup = actual_rollup(spark, sf_dir)
    dated = forecast.combined([rollup])
    path = scratch_path(spark, "export")
    write_export_csv(dated, path, ["regiao", "mes_ano"])
    return spark.read.schema(schemas.FORECAST_EXPORT).option("header", True).csv(path)


def export_without_numbers(spark, sf_dir):
    rollup = forecast.combined([actual_rollup(spark, sf_dir)])
    path = scratch_path(spark, "export")
    write_export_csv(rollup, path, ["regiao", "mes_ano"])
    return read_export_csv(spark, path, schemas.FORECAST_EXPORT)


def sheet_roundtrip(spark, sf_dir):
    """The time sheet landed as a named sheet of a bundle and read back from there."""
    bundle = scratch_path(spark, "bundle")
    write_table(b.time_sheet(b.monthly_lines(spark, sf_dir)), f"{bundle}/tempo_de_procedimentos")
    sheet = read_sheet(spark, bundle, "tempo de procedimentos")
    times = sheet.select("ano", "regiao", *reshape.columns_with_prefix(sheet, "TEMPO_"))
    return reshape.sum_all(times, "ano", "regiao")


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        month_count_sql,
        priority_count_sql,
        month_series_by_region,
        month_series_from_text,
        code_prefix_join,
        two_hop_join,
        distinct_periods,
        region_slice,
        union_extracts,
        first_months,
        frame_profile,
        clean_names_scan,
        category_codes,
        complete_months,
        split_by_duration,
        split_by_date,
        split_plan,
        future_frame,
        total_series,
        trend_season_design,
        fit_trend_season,
        fit_ets,
        fit_gapped,
        fit_arima,
        differencing_orders,
        model_table,
        calibrate,
        calibrate_ets,
        calibration_of,
        accuracy,
        accuracy_ets,
        refit_forecast,
        refit_forecast_ets,
        forecast_with_actuals,
        forecast_with_actuals_ets,
        actual_rows,
        forecast_intervals,
        holdout_forecast,
        forecast_frame_80,
        observed_and_forecast,
        in_sample_fit,
        fitted_values,
        model_intervals,
        forecast_vs_observed,
        forecast_vs_observed_ets,
        mae_mape,
        mae_mape_ets,
        forecast_rollup,
        forecast_rollup_ets,
        actual_rollup,
        forecast_combined,
        forecast_combined_ets,
        panel_row_counts,
        canonical_labels,
        procedure_times,
        procedure_rank,
        yearly_demand,
        demand_long,
        supply_by_year,
        demand_supply,
        scenario_totals,
        gap_labels,
        deficit,
        deficit_by_year,
        deficit_common_years,
        deficit_unique_keys,
        deficit_long,
        workload,
        export_roundtrip,
        export_without_numbers,
        sheet_roundtrip,
    )
}
