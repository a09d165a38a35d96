import csv
import datetime
from pathlib import Path
from types import SimpleNamespace

import pytest

from tidecast import sources
from tidecast.session import scratch_path, shared_dir, stage
from tidecast.sources import schemas
from tidecast.sources.names import snake_name, unique_names


def test_names():
    assert snake_name("CO_MUNICIP") == "co_municip"
    assert snake_name("Nível de atenção") == "nivel_de_atencao"
    assert snake_name("Tempo (horas) %") == "tempo_horas_percent"
    assert snake_name("DsNomePad") == "ds_nome_pad"
    assert snake_name("2021") == "x2021"
    assert unique_names(["a", "a", "b", "a"]) == ["a", "a_2", "b", "a_3"]


def test_clean_names_touches_only_the_schema(spark):
    df = spark.createDataFrame([(1, 2)], "`A b` int, `a-B` int")
    assert sources.clean_names(df).columns == ["a_b", "a_b_2"]


def test_csv_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("﻿cod_municipio,macrorregiao\n521225,Macrorregião Sudoeste\n520085,NA\n")
    rows = sources.read_csv_table(spark, str(path), schemas.MUNICIPALITY_REGION).collect()
    assert [tuple(r) for r in rows] == [(521225, "Macrorregião Sudoeste"), (520085, None)]


def test_numbering_follows_the_order_over_partitions(spark):
    df = spark.range(0, 1000, numPartitions=7).selectExpr("999 - id AS k", "id % 3 AS g")
    rows = sources.number_rows(df, ["g", "k"]).collect()
    expected = sorted((i % 3, 999 - i) for i in range(1000))
    assert [(r.g, r.k) for r in sorted(rows, key=lambda r: r.row_id)] == expected
    assert sorted(r.row_id for r in rows) == list(range(1, 1001))


def test_export_round_trip(spark):
    month = datetime.date(2021, 10, 1)
    rows = [("2021-10", 2021, 2.5, "previsto", "b", month), ("2021-10", 2021, 1.5, "previsto", "a", month)]
    names = schemas.FORECAST_EXPORT.fieldNames()[1:]
    df = spark.createDataFrame(rows, schemas.FORECAST_EXPORT[1:])
    path = scratch_path(spark, "export")
    sources.write_export_csv(df, path, ["regiao", "mes_ano"])
    header = spark.read.text(path).first().value
    assert header.startswith('"",') or header.startswith(",")
    back = sources.read_export_csv(spark, path, schemas.FORECAST_EXPORT)
    assert back.columns == names
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)


def test_sheet(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    sources.write_table(df, str(tmp_path / "tempo_de_procedimentos"))
    assert sources.read_sheet(spark, str(tmp_path), "Tempo de procedimentos").collect() == df.collect()
    df.write.option("header", True).csv(str(tmp_path / "plain"))
    assert sources.read_sheet(spark, str(tmp_path), "plain", df.schema).collect() == df.collect()


def test_columns_are_found_by_their_header(spark, tmp_path):
    path = tmp_path / "turned.csv"
    path.write_text("macrorregiao,Cod Municipio\nNorte,521225\n,\n")
    rows = sources.read_csv_table(spark, str(path), schemas.MUNICIPALITY_REGION).collect()
    assert [tuple(r) for r in rows] == [(521225, "Norte"), (None, None)]


def test_malformed_fields_and_missing_columns_are_errors(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("cod_municipio,macrorregiao\n52x,Norte\n")
    with pytest.raises(Exception, match="cod_municipio is not of type int: 52x"):
        sources.read_csv_table(spark, str(path), schemas.MUNICIPALITY_REGION).collect()
    path.write_text("cod_municipio,regiao\n521225,Norte\n")
    with pytest.raises(ValueError, match="macrorregiao"):
        sources.read_csv_table(spark, str(path), schemas.MUNICIPALITY_REGION)


def test_export_files_follow_the_row_numbers(spark):
    df = spark.range(0, 4000, numPartitions=8).selectExpr("id AS k", "repeat('x', int(id % 90)) || '\"' AS v")
    path = scratch_path(spark, "export")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sources.write_export_csv(df, path, ["k"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    folder = Path(path.removeprefix("file:"))
    numbers, files = [], sorted(folder.glob("part-*.csv"))
    for file in files:
        with file.open(newline="") as lines:
            found = list(csv.reader(lines))[1:]
        numbers += [int(row[0]) for row in found]
        assert all(row[2].endswith('"') for row in found)
    assert len(files) > 1 and numbers == list(range(1, 4001))


def test_sql_extract_names_its_inputs(spark):
    records = [("1", "01092020"), ("1", "15092020"), ("2", "01092020")]
    births = spark.createDataFrame(records, "c string, d string")
    query = """
        SELECT c, substring(d, 3, 6) AS m, count(*) AS n FROM {births} WHERE c = '1' GROUP BY 1, 2
    """
    found = sources.sql_extract(spark, query, births=births).collect()
    assert [tuple(r) for r in found] == [("1", "092020", 2)]


def test_literal_table(spark):
    assert sources.literal_table(spark, [("a", 1)], "k string, v int").first().v == 1


def test_staging_uses_the_shared_folder(spark):
    staged = stage(spark.range(5))
    assert staged.count() == 5
    assert all(f"{shared_dir(spark)}/stage-" in name for name in staged.inputFiles())


def test_shared_folder_is_the_one_the_session_names():
    named = SimpleNamespace(conf={"spark.checkpoint.dir": "hdfs://shared/work"})
    assert shared_dir(named) == "hdfs://shared/work"


def test_a_cluster_must_name_a_shared_folder():
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="yarn")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(conf={}, sparkContext=context))


def test_repeated_export_is_refused(spark):
    path = scratch_path(spark, "twice")
    sources.write_table(spark.range(1), path)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        sources.write_table(spark.range(1), path)
