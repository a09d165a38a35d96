"""Physical plans: what reaches the scan, and what meets a join or a fit."""

import re

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from tidecast.operators import evaluate, packing, panel, reshape, smoothing, split
from tidecast.plans import bindings

SF_DIR = "/root/testdata/sf0.001"


def physical_plan(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def test_cutoff_and_columns_reach_the_scan(spark):
    plan = physical_plan(bindings.panel(spark, SF_DIR))
    scans = [part for part in plan.split("\n\n") if "Scan parquet" in part and "o_orderdate" in part]
    assert len(scans) == 1
    assert "LessThan(o_orderdate" in scans[0]
    assert "ReadSchema: struct<o_custkey:bigint,o_orderdate:timestamp_ntz>" in scans[0]


def test_supply_years_reach_the_scan(spark):
    plan = physical_plan(bindings.monthly_lines(spark, SF_DIR, since="1998-01-01"))
    assert "GreaterThanOrEqual(l_shipdate" in plan


def test_a_hot_code_can_be_counted_before_the_join(spark):
    """Nine of ten events carry one code; it must reach the join as one row per month."""
    hot = F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(-1))
    month = F.add_months(F.lit("2020-01-01").cast("date"), (F.col("id") % 3).cast("int"))
    events = spark.range(0, 30000, numPartitions=6).select(hot.alias("code"), month.alias("month"))
    regions = events.select(F.col("code").alias("cod"), F.lit("r").alias("name")).distinct()
    found = panel.month_series(
        events, "code", F.col("month"), regions, "cod", "name", count_codes_first=True
    )
    assert [r.y for r in found.orderBy("ds").collect()] == [10000.0] * 3
    per_code = panel.month_totals(events, ["code"], F.col("month"))
    assert per_code.filter("code = -1").count() == 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    joined = plan[plan.index("Join") :]
    assert "partial_count" in joined


def test_pivot_shuffles_once(spark):
    df = spark.range(10).selectExpr("id % 2 AS k", "'x' AS s", "1.0D AS v")
    plan = df.transform(lambda d: reshape.to_wide(d, "s", "v", ["x", "y"], "sum"))
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_split_and_fit_share_one_shuffle(spark, monthly):
    df = monthly({"a": range(40), "b": range(40)})
    train = split.training(split.split_by_duration(df))
    plan = smoothing.fit(train)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "REPARTITION_BY_NUM" in plan


def test_filled_months_read_the_panel_once(spark):
    monthly_totals = bindings.panel(spark, SF_DIR)
    plan = panel.complete_months(monthly_totals, 0.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("o_orderdate") and plan.count("FileScan parquet [o_custkey") == 1


def test_total_series_reads_the_panel_once(spark):
    both = panel.with_total_series(bindings.panel(spark, SF_DIR))
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet [o_custkey") == 1


@pytest.mark.parametrize("partitions", ["3", "5"])
def test_series_are_spread_over_the_set_number_of_partitions(spark, monthly, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        packed = packing.pack_series(monthly({str(i): [1, 2] for i in range(60)}))
        assert packed.rdd.getNumPartitions() == int(partitions)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def _event_shuffles(spark, found) -> int:
    """Exchanges below the partial count, that is of events and regions themselves."""
    plan = found._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("partial_count") :]
    return len(re.findall(r"\bExchange hashpartitioning", below))


def test_events_meet_the_regions_before_they_are_counted(spark):
    hot = F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(-1))
    month = F.add_months(F.lit("2020-01-01").cast("date"), (F.col("id") % 3).cast("int"))
    events = spark.range(0, 30000, numPartitions=6).select(hot.alias("code"), month.alias("month"))
    regions = spark.range(-1, 30000).select(F.col("id").alias("cod"), F.lit("r").alias("name"))

    def totals(side):
        return panel.month_series(events, "code", F.col("month"), side, "cod", "name")

    small = totals(F.broadcast(regions))
    assert _event_shuffles(spark, small) == 0
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = totals(regions)
        assert _event_shuffles(spark, large) == 2  # one of each side
        for found in (small, large):
            assert [r.y for r in found.orderBy("ds").collect()] == [10000.0] * 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_series_named_like_the_total_is_an_error(monthly):
    with pytest.raises(Exception, match="name of the total"):
        panel.with_total_series(monthly({"ALL": [1.0], "a": [2.0]})).collect()


def test_calibration_joins_by_series_only(spark, monthly):
    parts = split.split_by_duration(monthly({"a": range(40), "b": range(40)}))
    models = evaluate.fit_models(split.training(parts))
    rows = evaluate.calibrate(models, split.testing(parts))
    joins = [line for line in rows._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join " in line]
    assert len(joins) == 3
    assert not any("ds#" in line.split("(", 1)[1] and "= ds#" in line for line in joins)
    assert rows.count() == 3 * 2 * 12
    assert rows.filter("abs(residual - (actual - prediction)) > 1e-9 or actual is null").count() == 0
