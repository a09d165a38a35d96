"""Demand for staff time against supply, and the gap between them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions.dates import date_literal
from tidecast.functions.labels import MACRO_REGIONS, canonical_label, recode
from tidecast.functions.numbers import as_number, round_half_even, strict_mean, strict_sum
from tidecast.operators.reshape import (
    columns_between,
    columns_with_prefix,
    mean_all,
    split_in_two,
    sum_all,
    to_long,
    to_wide,
)

# Levels of care, professions, scenario labels and minutes of a staff day pair.
CARE_LEVELS = {1.0: "Primária", 2.0: "Especializada"}
STAFF = ["medico_ab", "medico_esp", "enf_ab"]
DEMAND = "demanda"
SCENARIOS = {
    "Oferta - Cenário 1 - constante": "oferta1",
    "Oferta - Cenário 2 - aumento de 5% ao ano": "oferta2",
    "Oferta - Cenário 3 - alteração para os níveis pré-pandemia (12/2019)": "oferta3",
    "demanda": "demanda",
}
STATUSES = ["demanda", "oferta1", "oferta2", "oferta3"]
SHIFT_MINUTES = 960

# Share of each procedure's minutes that falls to a profession.
WORKLOAD = {
    "tempo_medico_ab": {
        "tempo_consulta_prenatal": 0.5,
        "tempo_consulta_puerperal": 0.5,
        "tempo_acoes_educativas": 0.5,
        "tempo_ultrassonografia_obstetrica": 1.0,
        "tempo_exame_citopatologico": 1.0,
    },
    "tempo_medico_esp": {
        "tempo_consulta_especializada": 1.0,
        "tempo_ecg": 1.0,
        "tempo_ultrassom_obstetrico_dopler": 1.0,
        "tempo_ultrassom_obstetrico": 1.0,
        "tempo_tococardiografia": 1.0,
        "tempo_parto_cesarea": 1.0,
        "tempo_parto_normal_sem_instrumentacao": 1.0,
    },
    "tempo_enfermeiro": {
        "tempo_consulta_prenatal": 0.5,
        "tempo_consulta_puerperal": 0.5,
        "tempo_acoes_educativas": 0.5,
    },
}


def procedure_times(sheet: DataFrame) -> DataFrame:
    """Mean time per region and procedure, from one column per ``"procedure,level"``."""
    means = mean_all(sheet.drop("mes_ano", "ano"), "regiao")
    long = to_long(means, columns_between(means, 2, len(means.columns)), "procedimento", "tempo")
    parts = split_in_two(long, "procedimento", ("procedimento", "nivel_atencao"), ",")
    numbered = parts.withColumn("nivel", as_number("nivel_atencao"))
    return numbered.withColumn("atencao", recode("nivel", CARE_LEVELS))


def procedure_rank(times: DataFrame) -> DataFrame:
    """Procedures in the order of their median time over regions."""
    medians = times.groupBy("procedimento").agg(F.median("tempo").alias("mediana"))
    # One row per procedure column of the sheet, so a single ordered window is bounded.
    order = Window.orderBy("mediana", "procedimento")
    return medians.withColumn("posicao", F.row_number().over(order))


def yearly_demand(sheet: DataFrame, staff: Sequence[str], prefix: str = "tempo_") -> DataFrame:
    """Sum of every time column and staff column per year and region."""
    measures = columns_with_prefix(sheet, prefix) + list(staff)
    return sum_all(sheet.select("ano", "regiao", *measures), "ano", "regiao")


def demand_long(demand: DataFrame, staff: Sequence[str] = tuple(STAFF)) -> DataFrame:
    """Demand per year, region and profession, tagged as demand."""
    chosen = demand.select("ano", "regiao", *staff)
    long = to_long(chosen, columns_between(chosen, 3, 2 + len(staff)), "profissional", "total")
    return long.withColumn("cenario", F.lit(DEMAND))


def supply_by_year(supply: DataFrame, after: int = 2021) -> DataFrame:
    """Supply per year, region, level of care, profession and scenario.

    The level of care is a grouping key that the result does not show, so a result key can repeat.
    The year is bounded on the stored date, which a scan can use.
    """
    recent = supply.filter(F.col("mes_ano") >= date_literal(f"{after + 1}-01-01"))
    yearly = recent.withColumn("ano", F.year("mes_ano"))
    totals = yearly.groupBy("macrorregiao", "ano", "nivel_atencao", "categoria", "cenario").agg(
        strict_sum("qtd_mensal").alias("total")
    )
    return totals.select(
        "ano",
        F.col("macrorregiao").alias("regiao"),
        F.col("categoria").alias("profissional"),
        "total",
        "cenario",
    )


def demand_and_supply(supply: DataFrame, demand: DataFrame, common_years: bool = False) -> DataFrame:
    """Supply and demand in one table.

    A year that only one side has stays, and its gap is missing, unless ``common_years`` asks for the
    years of both.
    """
    if not common_years:
        return supply.unionByName(demand)
    # One row per calendar year.
    years = supply.select("ano").distinct().join(demand.select("ano").distinct(), "ano")
    return supply.unionByName(demand).join(years, "ano", "left_semi")


def gap_labels(both: DataFrame, professionals: Sequence[str] | None = None) -> DataFrame:
    """Rows behind the demand-against-supply charts, with the total rounded for its label."""
    chosen = both if professionals is None else both.filter(F.col("profissional").isin(*professionals))
    return chosen.withColumn("rotulo", round_half_even("total"))


def deficit(
    both: DataFrame,
    scenarios: Mapping[str, str] = SCENARIOS,
    by_year: bool = False,
    duplicates: str = "fail",
) -> DataFrame:
    """Supply less demand per region and profession, for each supply scenario.

    The year is averaged with the measures unless ``by_year`` asks for one row per year.
    """
    named = both.withColumn("status", recode("cenario", scenarios)).drop("cenario")
    wide = to_wide(named, "status", "total", STATUSES, duplicates)
    keys = ["regiao", "profissional"] + (["ano"] if by_year else [])
    measures = [c for c in ["ano", *STATUSES] if c not in keys]
    means = wide.groupBy(*keys).agg(*[strict_mean(c).alias(c) for c in measures])
    gaps = {
        f"resultado{i}": F.col(f"oferta{i}") - F.col("demanda") for i in range(1, len(STATUSES))
    }
    return means.withColumns(gaps)


def deficit_long(gaps: DataFrame) -> DataFrame:
    chosen = gaps.select(
        "ano", "regiao", "profissional", "resultado1", "resultado2", "resultado3"
    )
    return to_long(chosen, columns_between(chosen, 4, 6), "cenario", "resultado")


def observed_and_forecast(
    forecast: DataFrame, panel: DataFrame, names: Mapping[str, str] = MACRO_REGIONS
) -> DataFrame:
    """Forecast and observed months under canonical region names.

    ``forecast`` has ``regiao, mes_ano_data, total``; ``panel`` is a monthly panel.
    """
    ahead = forecast.select(
        F.col("regiao").alias("macrorregiao"),
        F.col("mes_ano_data").alias("data"),
        "total",
        F.lit("previsto").alias("status"),
    )
    seen = panel.select(
        F.col("series_id").alias("macrorregiao"),
        F.col("ds").alias("data"),
        F.col("y").alias("total"),
        F.lit("atual").alias("status"),
    )
    both = ahead.unionByName(seen)
    return both.withColumn("macrorregiao", canonical_label("macrorregiao", names))


def workload(
    sheet: DataFrame,
    keys: Sequence[str],
    shares: Mapping[str, Mapping[str, float]] = WORKLOAD,
    minutes: int = SHIFT_MINUTES,
) -> DataFrame:
    """Weighted minutes per profession as shifts, one row per input row and profession."""
    columns = {}
    for name, weights in shares.items():
        terms = [F.col(c) * w for c, w in weights.items()]
        columns[name] = sum(terms[1:], terms[0]) / minutes
    wide = sheet.withColumns(columns).select(*keys, *shares)
    return to_long(wide, list(shares), "profissional", "total")
