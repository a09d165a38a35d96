"""The inputs of the pipelines, derived from the star-schema tables.

Events are ``orders``, the code that places an event is the customer key, and regions come from the
customer's nation. Procedure times and supply come from ``lineitem`` by the supplier's region.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.functions.dates import date_literal, month_start, year_month_text
from tidecast.operators.capacity import SCENARIOS
from tidecast.operators.panel import month_series, with_total_series
from tidecast.session import stage
from tidecast.sources import read_parquet_table

# The last month holds one day only, so it is left out.
CUTOFF = "2001-08-01"
FLAGS = ["A", "N", "R"]
STATUSES = ["F", "O"]
# Staff hours that one counted line stands for, per supply scenario.
SCENARIO_HOURS = dict(zip([s for s in SCENARIOS if s != "demanda"], (20.0, 21.0, 19.0)))
REGION_NAMES = {
    "africa": "Africa",
    "america": "America",
    "asia": "Asia",
    "europe": "Europe",
    "middle east": "Middle-East",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet_table(spark, sf_dir, name)


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nations.join(regions, nations.n_regionkey == regions.r_regionkey, "left")


def customer_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(c_custkey, r_name)``, over the two hops customer, nation, region."""
    customers, regions = table(spark, sf_dir, "customer"), _regions(spark, sf_dir)
    joined = customers.join(regions, customers.c_nationkey == regions.n_nationkey, "left")
    return joined.select("c_custkey", "r_name")


def supplier_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers, regions = table(spark, sf_dir, "supplier"), _regions(spark, sf_dir)
    joined = suppliers.join(regions, suppliers.s_nationkey == regions.n_nationkey, "left")
    return joined.select("s_suppkey", F.col("r_name").alias("regiao"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per region and month. The cutoff is on the stored column, so it reaches the scan."""
    orders = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") < date_literal(CUTOFF))
    regions = customer_regions(spark, sf_dir)
    return month_series(
        orders, "o_custkey", month_start("o_orderdate"), regions, "c_custkey", "r_name"
    )


def scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with its total series, computed once: every model and split reads it."""
    return stage(with_total_series(panel(spark, sf_dir)))


def staged_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(panel(spark, sf_dir))


def monthly_lines(spark: SparkSession, sf_dir: str, since: str | None = None) -> DataFrame:
    """Line counts and quantities per supplier region, month, return flag and line status.

    Lines meet the regions first and are totalled in the same stage, so what is shuffled are totals.
    Without ``since`` every line counts, also one without a ship date.
    """
    lines = table(spark, sf_dir, "lineitem")
    if since is not None:
        lines = lines.filter(F.col("l_shipdate") >= date_literal(since))
    regions = supplier_regions(spark, sf_dir)
    placed = lines.join(regions, lines.l_suppkey == regions.s_suppkey, "left")
    keys = ["regiao", month_start("l_shipdate").alias("data"), "l_returnflag", "l_linestatus"]
    return placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("linhas"), F.sum("l_quantity").alias("quantidade")
    )


def procedure_sheet(lines: DataFrame) -> DataFrame:
    """Mean quantity per month and region, one column per ``"flag,level"``."""
    cells = []
    for flag in FLAGS:
        for level, status in enumerate(STATUSES, start=1):
            here = (F.col("l_returnflag") == flag) & (F.col("l_linestatus") == status)
            amount, count = F.when(here, F.col("quantidade")), F.when(here, F.col("linhas"))
            cells.append(F.try_divide(F.sum(amount), F.sum(count)).alias(f"{flag},{level}"))
    months = [year_month_text("data").alias("mes_ano"), F.year("data").alias("ano"), "regiao"]
    return lines.groupBy(*months).agg(*cells)


def time_sheet(lines: DataFrame) -> DataFrame:
    """Monthly times (``tempo_*``) and staff (one column per return flag) by region."""

    def total(flag: str, column: str):
        kept = F.when(F.col("l_returnflag") == flag, F.col(column)).otherwise(0.0)
        return F.sum(kept)

    times = [total(flag, "quantidade").alias(f"tempo_{flag.lower()}") for flag in FLAGS]
    staff = [(total(flag, "linhas") * 20.5).alias(flag) for flag in FLAGS]
    months = [year_month_text("data").alias("mes_ano"), F.year("data").alias("ano"), "regiao"]
    return lines.groupBy(*months).agg(*times, *staff)


def supply_sheet(lines: DataFrame) -> DataFrame:
    """Monthly supply by region, level (line status), profession (return flag) and scenario."""
    scenarios = F.array(
        *[
            F.struct(F.lit(name).alias("cenario"), F.lit(hours).alias("horas"))
            for name, hours in SCENARIO_HOURS.items()
        ]
    )
    planned = lines.select("*", F.inline(scenarios))
    return planned.select(
        F.col("regiao").alias("macrorregiao"),
        F.col("data").alias("mes_ano"),
        F.col("l_linestatus").alias("nivel_atencao"),
        F.col("l_returnflag").alias("categoria"),
        "cenario",
        (F.col("linhas") * F.col("horas")).alias("qtd_mensal"),
    )
