"""Fixed schemas of the inputs. Nothing is inferred: inference reads ``2021-10`` as a timestamp."""

from pyspark.sql.types import (
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _schema(**fields) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields.items()])


MUNICIPALITY_REGION = _schema(cod_municipio=IntegerType(), macrorregiao=StringType())
FORECAST_EXPORT = _schema(
    row_id=LongType(),
    mes_ano=StringType(),
    ano=IntegerType(),
    total=DoubleType(),
    tipo=StringType(),
    regiao=StringType(),
    mes_ano_data=DateType(),
)
