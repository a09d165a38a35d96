import datetime

import pytest
from pyspark.sql import functions as F

from tidecast.operators import capacity


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_procedure_times_and_rank(spark):
    sheet = spark.createDataFrame(
        [
            ("2022-01", 2022, "N", 2.0, 8.0, 1.0),
            ("2022-02", 2022, "N", 4.0, None, 1.0),
            ("2022-01", 2022, "S", 6.0, 2.0, 9.0),
        ],
        "mes_ano string, ano int, regiao string, `consulta,1` double, `parto,2` double, `outro` double",
    )
    times = capacity.procedure_times(sheet)
    assert rows(times.filter("regiao = 'N'")) == [
        ("N", "consulta", "1", 3.0, 1.0, "Primária"),
        ("N", "outro", None, 1.0, None, None),
        ("N", "parto", "2", None, 2.0, "Especializada"),
    ]
    ranked = capacity.procedure_rank(times).orderBy("posicao").collect()
    assert [(r.procedimento, r.mediana) for r in ranked] == [("parto", 2.0), ("consulta", 4.5), ("outro", 5.0)]


@pytest.fixture
def sides(spark):
    sheet = spark.createDataFrame(
        [
            (2022, "N", 10.0, 1.0, 2.0, 3.0),
            (2022, "N", 20.0, 1.0, 2.0, 3.5),
            (2023, "N", 5.0, 4.0, 4.0, 4.0),
        ],
        "ano int, regiao string, tempo_x double, medico_ab double, medico_esp double, enf_ab double",
    )
    labels = [s for s in capacity.SCENARIOS if s != "demanda"]
    records = [
        ("N", datetime.date(year, 5, 1), "1", job, label, 10.0 * (i + 1))
        for year in (2021, 2022, 2023)
        for job in capacity.STAFF
        for i, label in enumerate(labels)
    ]
    supply = spark.createDataFrame(
        records,
        "macrorregiao string, mes_ano date, nivel_atencao string, categoria string, "
        "cenario string, qtd_mensal double",
    )
    demand = capacity.demand_long(capacity.yearly_demand(sheet, capacity.STAFF))
    return capacity.supply_by_year(supply), demand


def test_demand_is_long_and_tagged(sides):
    assert rows(sides[1].filter("ano = 2022")) == [
        (2022, "N", "enf_ab", 6.5, "demanda"),
        (2022, "N", "medico_ab", 2.0, "demanda"),
        (2022, "N", "medico_esp", 4.0, "demanda"),
    ]


def test_supply_starts_after_the_given_year(sides):
    assert {r.ano for r in sides[0].collect()} == {2022, 2023}


def test_deficit_averages_over_years(sides):
    both = capacity.demand_and_supply(*sides)
    gaps = {r.profissional: r for r in capacity.deficit(both).collect()}
    assert gaps["medico_ab"].ano == 2022.5
    assert gaps["medico_ab"].demanda == 3.0
    assert [gaps["medico_ab"][f"resultado{i}"] for i in (1, 2, 3)] == [7.0, 17.0, 27.0]
    yearly = capacity.deficit(both, by_year=True)
    assert yearly.count() == 6
    assert capacity.deficit_long(capacity.deficit(both)).count() == 9


def test_hidden_level_of_care_repeats_a_key(sides):
    both = capacity.demand_and_supply(*sides)
    doubled = both.unionByName(both.filter("cenario <> 'demanda'"))
    with pytest.raises(Exception, match="repeated cell"):
        capacity.deficit(doubled).collect()
    summed = capacity.deficit(doubled, duplicates="sum").filter("profissional = 'enf_ab'").first()
    assert summed.oferta1 == 20.0


def test_unknown_scenario_is_dropped_from_the_columns(sides):
    both = capacity.demand_and_supply(*sides)
    other = both.limit(1).withColumn("cenario", F.lit("outro"))
    assert capacity.deficit(both.unionByName(other)).columns == capacity.deficit(both).columns


def test_labels_are_rounded_half_even(spark):
    columns = "ano int, regiao string, profissional string, total double, cenario string"
    df = spark.createDataFrame([(2022, "N", "enf_ab", 2.5, "demanda")], columns)
    assert capacity.gap_labels(df, ["enf_ab"]).first().rotulo == 2.0
    assert capacity.gap_labels(df, ["medico_ab"]).count() == 0


def test_workload_in_shifts(spark):
    names = sorted({c for weights in capacity.WORKLOAD.values() for c in weights})
    sheet = spark.createDataFrame([(2022, "N", *[960.0] * len(names))], ["ano", "regiao", *names])
    found = {r.profissional: r.total for r in capacity.workload(sheet, ["ano", "regiao"]).collect()}
    assert found == {"tempo_medico_ab": 3.5, "tempo_medico_esp": 7.0, "tempo_enfermeiro": 1.5}


def test_observed_and_forecast_share_names(spark, monthly):
    ahead = spark.createDataFrame(
        [("centro_oeste", datetime.date(2021, 10, 1), 5.0)], "regiao string, mes_ano_data date, total double"
    )
    both = capacity.observed_and_forecast(ahead, monthly({"macrorregião Centro-Oeste": [1, 2]}))
    assert rows(both.groupBy("macrorregiao", "status").count()) == [
        ("Centro-Oeste", "atual", 2),
        ("Centro-Oeste", "previsto", 1),
    ]
