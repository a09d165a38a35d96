"""Readers and writers."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructType

from tidecast.session import stage
from tidecast.sources.names import snake_name, unique_names

ROW_ID = "row_id"


def read_parquet_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def read_csv_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV with a header line under a fixed schema; ``NA`` and empty fields are missing.

    Columns are found by their cleaned header names, whatever their order; a column that the file does
    not have is an error, and so is a field that is not of its type. A header without a name is the
    row number.
    """
    reader = (
        spark.read.option("header", True)
        .option("nullValue", "NA")
        .option("emptyValue", "")
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
    )
    text = reader.csv(path)
    named = [ROW_ID if _nameless(c) else snake_name(c) for c in text.columns]
    place = {name: i for i, name in enumerate(unique_names(named))}
    missing = [f.name for f in schema if snake_name(f.name) not in place]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    fields = text.toDF(*unique_names(named))
    return fields.select(*(_typed(f.name, snake_name(f.name), f.dataType) for f in schema))


def _nameless(header: str) -> bool:
    return header.strip() == "" or re.fullmatch(r"_c\d+", header) is not None


def _typed(name: str, column: str, kind: DataType) -> Column:
    """The text of a column in its type; empty is missing, and malformed text fails the query."""
    text = F.nullif(F.col(f"`{column}`"), F.lit(""))
    if isinstance(kind, StringType):
        return text.alias(name)
    value = text.try_cast(kind)
    fault = F.raise_error(F.concat(F.lit(f"{name} is not of type {kind.simpleString()}: "), text))
    return F.when(text.isNotNull() & value.isNull(), fault.cast(kind)).otherwise(value).alias(name)


def read_sheet(
    spark: SparkSession, bundle: str, sheet: str, schema: StructType | None = None
) -> DataFrame:
    """One named table of a bundle directory, as written by :func:`write_table`.

    Without a schema the sheet is Parquet; with one it is CSV.
    """
    path = f"{bundle.rstrip('/')}/{snake_name(sheet)}"
    return spark.read.parquet(path) if schema is None else read_csv_table(spark, path, schema)


def sql_extract(
    spark: SparkSession, query: str, bound: Mapping[str, object] | None = None, **inputs
) -> DataFrame:
    """Run SQL text.

    ``{name}`` in the text stands for the DataFrame passed as ``name``, ``:name`` for a bound value.
    """
    return spark.sql(query, args=dict(bound or {}), **inputs)


def warehouse_extract(
    spark: SparkSession,
    url: str,
    query: str,
    split_on: str | None = None,
    lower: str | None = None,
    upper: str | None = None,
    partitions: int = 64,
    **options: str,
) -> DataFrame:
    """Run SQL text in a remote warehouse over JDBC.

    With ``split_on`` the read is cut into ranges of that column, so that a large extract does not
    arrive through one connection.
    """
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    reader = reader.option("dbtable", f"({query}) extract")
    if split_on is not None:
        reader = (
            reader.option("partitionColumn", split_on)
            .option("lowerBound", lower)
            .option("upperBound", upper)
            .option("numPartitions", partitions)
        )
    return reader.load()


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small table of constants written in code (labels, scenarios, coefficients)."""
    return spark.createDataFrame(list(rows), schema)


def number_rows(df: DataFrame, keys: Sequence[str], name: str = ROW_ID) -> DataFrame:
    """Number the rows 1, 2, 3 ... in the order of ``keys``.

    A window without a partition would move all rows into one task. Here the rows are range-sorted and
    numbered inside their partition before they are staged, and only the counts (one per partition) are
    accumulated.
    """
    # The identifier counts up in a partition, which its upper bits name.
    place = F.monotonically_increasing_id()
    ordered = stage(df.orderBy(*keys).withColumn("_place", place))
    part = F.shiftright("_place", 33)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    # One row per partition of the sort: bounded by spark.sql.shuffle.partitions.
    offsets, before = {}, 0
    for row in sizes.orderBy("_part").collect():
        offsets[row["_part"]], before = before, before + row["_rows"]
    if not offsets:
        return ordered.select(F.lit(0).cast("long").alias(name), *df.columns)
    table = F.create_map(*(F.lit(x) for pair in offsets.items() for x in pair))
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    row_id = (inside + table[part] + 1).cast("long").alias(name)
    return ordered.select(row_id, *df.columns)


def write_export_csv(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """CSV export: header, quoted text, and a leading row number in a column without a name.

    Files follow one another in the order of the row numbers.
    """
    numbered = number_rows(df, keys).orderBy(ROW_ID).withColumnRenamed(ROW_ID, "")
    writer = numbered.write.mode("errorifexists").option("header", True).option("quoteAll", True)
    writer.option("escape", '"').csv(path)


def read_export_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Read an export back; ``schema`` names the row number, which is dropped."""
    return read_csv_table(spark, path, schema).drop(ROW_ID)


def write_table(df: DataFrame, path: str) -> None:
    """Write a result table as Parquet."""
    df.write.mode("errorifexists").parquet(path)
