import datetime

import pytest
from pyspark.sql import functions as F

from tidecast.functions import dates, labels, metrics, numbers


def values(df, column):
    return [r[column] for r in df.select(column).collect()]


def test_lenient_month_parse_gives_null_for_bad_text(spark):
    df = spark.createDataFrame([("01092020",), ("01132020",), ("",)], "dtnasc string")
    parsed = df.select(dates.month_year(dates.text_between("dtnasc", 3, 8)).alias("m"))
    assert values(parsed, "m") == [datetime.date(2020, 9, 1), None, None]


def test_strict_month_parse_fails_on_bad_text(spark):
    df = spark.createDataFrame([("132020",)], "m string")
    with pytest.raises(Exception, match="CANNOT_PARSE_TIMESTAMP|could not be parsed"):
        df.select(dates.month_year_strict("m")).collect()


def test_year_month_round_trip(spark):
    df = spark.createDataFrame([("2021-10",), ("2021-13",)], "m string")
    parsed = df.select(dates.year_month("m").alias("d"))
    assert values(parsed, "d") == [datetime.date(2021, 10, 1), None]
    texts = parsed.select(dates.year_month_text("d").alias("t"))
    assert values(texts, "t") == ["2021-10", None]


def test_months_apart(spark):
    df = spark.sql("SELECT DATE'2021-03-01' AS b, DATE'2019-11-01' AS a")
    assert df.select(dates.months_apart("b", "a").alias("n")).first().n == 16


def test_number_text(spark):
    df = spark.createDataFrame([(" 1",), ("2",), ("NA",)], "x string")
    assert values(df.select(numbers.as_number("x").alias("v")), "v") == [1.0, 2.0, None]


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double")
    assert values(df.select(numbers.round_half_even("x").alias("v")), "v") == [0, 2, 2]


def test_strict_sum_is_null_when_any_value_is(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (2, 2.0)], "k int, x double")
    sums = df.groupBy("k").agg(
        numbers.strict_sum("x").alias("s"), numbers.strict_mean("x").alias("m")
    )
    assert {r.k: (r.s, r.m) for r in sums.collect()} == {1: (None, None), 2: (2.0, 2.0)}


def test_label_spellings(spark):
    spelled = [
        "macrorregião Centro-Oeste",
        "centro_oeste",
        "Centro Oeste",
        "Macrorregi?o Nordeste",
        "nordeste",
        "Norte",
    ]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(spelled)], "i int, s string")
    named = df.orderBy("i").select(labels.canonical_label("s").alias("n"))
    expected = ["Centro-Oeste"] * 3 + ["Nordeste"] * 2 + [None]
    assert values(named, "n") == expected


def test_recode_has_no_default(spark):
    df = spark.createDataFrame([("a",), ("b",)], "x string")
    assert values(df.select(labels.recode("x", {"a": 1}).alias("v")), "v") == [1, None]


def test_ordered_codes(spark):
    df = spark.createDataFrame([("1/22",), ("2/24",), ("3/99",)], "x string")
    batches = ["1/22", "2/22", "1/23", "2/23", "1/24", "2/24"]
    coded = df.select(labels.ordered_codes("x", batches).alias("v"))
    assert values(coded, "v") == [1, 6, None]


@pytest.mark.parametrize(
    "rows, by_forecast, by_observed",
    [([(10.0, 8.0), (20.0, 20.0)], 0.125, 10.0), ([(10.0, 8.0), (0.0, 5.0)], 0.625, None)],
)
def test_mape_roles(spark, rows, by_forecast, by_observed):
    df = spark.createDataFrame(rows, "y double, p double")
    found = df.agg(
        metrics.mape_fraction(F.col("p"), F.col("y")).alias("f"),
        metrics.mape_percent(F.col("y"), F.col("p")).alias("o"),
    ).first()
    assert found.f == pytest.approx(by_forecast)
    assert found.o is None if by_observed is None else found.o == pytest.approx(by_observed)


def test_r_squared_of_a_constant_forecast_is_missing(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "y double, p double")
    assert df.agg(metrics.r_squared(F.col("y"), F.col("p")).alias("r")).first().r is None
