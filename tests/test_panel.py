import datetime

import pytest
from pyspark.sql import functions as F

from tidecast.operators import panel, reshape, split

D = datetime.date


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def births(spark):
    records = [(520085, "2020-09-03", 2), (520085, "2020-09-20", 3), (521630, "2020-10-01", 4)]
    records += [(999999, "2020-09-01", 5), (520001, "2020-09-01", 6)]
    df = spark.createDataFrame(records, "code int, day string, contagem int")
    return df.withColumn("day", F.to_date("day"))


@pytest.fixture
def regions(spark):
    return spark.createDataFrame(
        [(520085, "Centro-Oeste"), (521630, "Sudoeste"), (520001, "NA")], "cod int, macro string"
    )


def test_unmatched_codes_and_text_NA_are_left_out(births, regions):
    month = F.trunc("day", "month")
    summed = panel.month_series(births, "code", month, regions, "cod", "macro", "contagem")
    assert rows(summed) == [
        ("Centro-Oeste", D(2020, 9, 1), 5.0),
        ("Sudoeste", D(2020, 10, 1), 4.0),
    ]
    counted = panel.month_series(births, "code", month, regions, "cod", "macro")
    assert [r[2] for r in rows(counted)] == [2.0, 1.0]


def test_a_missing_count_makes_its_month_missing(spark, regions):
    df = spark.createDataFrame([(520085, 1), (520085, None)], "code int, contagem int")
    month = F.lit("2020-09-01").cast("date")
    found = panel.month_series(df, "code", month, regions, "cod", "macro", "contagem")
    assert rows(found) == [("Centro-Oeste", D(2020, 9, 1), None)]


def test_total_series(monthly):
    both = panel.with_total_series(monthly({"a": [1, 2], "b": [10]}))
    totals = {r.ds: r.y for r in both.filter("series_id = 'ALL'").collect()}
    assert totals == {D(2010, 1, 1): 11.0, D(2010, 2, 1): 2.0}
    assert both.count() == 5


def test_complete_months(spark):
    df = spark.createDataFrame(
        [("a", D(2020, 1, 1), 1.0), ("a", D(2020, 4, 1), 2.0), ("b", D(2020, 2, 1), None)],
        "series_id string, ds date, y double",
    )
    filled = rows(panel.complete_months(df, 0.0))
    assert [(r[1].month, r[2]) for r in filled if r[0] == "a"] == [(1, 1.0), (2, 0.0), (3, 0.0), (4, 2.0)]
    assert [r for r in filled if r[0] == "b"] == [("b", D(2020, 2, 1), None)]
    assert [r[2] for r in rows(panel.complete_months(df)) if r[0] == "a"].count(None) == 2


def test_profile_counts_missing_values(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert rows(panel.frame_profile(df)) == [(1, "a", "int", 2, 2), (2, "b", "string", 2, 1)]


def test_slice_periods_counts_and_head(monthly):
    df = monthly({"a": [1, 2, 3], "b": [4, 5, 6]})
    assert panel.slice_series(df, "a").columns == ["ds", "y"]
    assert panel.periods(df).count() == 3
    assert rows(panel.row_counts(df, "series_id")) == [("a", 3), ("b", 3)]
    assert [r.y for r in panel.first_rows(df, ["series_id", "ds"], 4).collect()] == [1, 2, 3, 4]


def test_unpivot_keeps_missing_values(spark):
    df = spark.createDataFrame([(1, None, 2.0)], "k int, a double, b double")
    assert rows(reshape.to_long(df, ["a", "b"], "n", "v")) == [(1, "a", None), (1, "b", 2.0)]


def test_split_parts(spark):
    df = spark.createDataFrame([("a,1",), ("b",), ("c,2,x",)], "p string")
    found = rows(reshape.split_in_two(df, "p", ("p", "q"), ","))
    assert found == [("a", "1"), ("b", None), ("c", "2")]


def test_pivot_refuses_or_sums_duplicates(spark):
    df = spark.createDataFrame([(1, "x", 1.0), (1, "x", 2.0), (1, "y", 5.0)], "k int, s string, v double")
    with pytest.raises(Exception, match="repeated cell"):
        reshape.to_wide(df, "s", "v", ["x", "y"]).collect()
    assert rows(reshape.to_wide(df, "s", "v", ["x", "y"], "sum")) == [(1, 3.0, 5.0)]


def test_pivot_makes_no_column_for_missing_levels(spark):
    df = spark.createDataFrame([(1, None, 1.0), (1, "x", 2.0)], "k int, s string, v double")
    wide = reshape.to_wide(df, "s", "v", ["x", "y"])
    assert wide.columns == ["k", "x", "y"]
    assert rows(wide) == [(1, 2.0, None)]


def test_columns_by_prefix_and_position(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Tempo_a int, b int, tempo_c int")
    assert reshape.columns_with_prefix(df, "tempo_") == ["Tempo_a", "tempo_c"]
    assert reshape.columns_between(df, 2, 3) == ["b", "tempo_c"]


def test_whole_row_aggregates_are_strict(spark):
    df = spark.createDataFrame([("k", 1.0, 2.0), ("k", 3.0, None)], "k string, `a,1` double, b double")
    assert rows(reshape.mean_all(df, "k")) == [("k", 2.0, None)]
    assert rows(reshape.sum_all(df, "k")) == [("k", 4.0, None)]


def test_duration_split_takes_the_last_year_of_each_series(monthly):
    parts = split.split_by_duration(monthly({"a": range(30), "b": range(20)}))
    counts = rows(parts.groupBy("series_id", "split_key").count())
    assert counts == [
        ("a", "testing", 12),
        ("a", "training", 18),
        ("b", "testing", 12),
        ("b", "training", 8),
    ]
    plan = split.split_plan(parts)
    assert plan.columns == ["id", "key", "series_id", "ds", "y"]


def test_future_frame(monthly):
    df = monthly({"a": range(14)})
    ahead = [r.ds for r in split.future_frame(df, 3).orderBy("ds").collect()]
    assert ahead == [D(2011, 3, 1), D(2011, 4, 1), D(2011, 5, 1)]
    assert split.future_frame(df, 3, history=True).count() == 17
