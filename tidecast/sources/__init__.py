from tidecast.sources.names import clean_names
from tidecast.sources.tables import (
    literal_table,
    number_rows,
    read_csv_table,
    read_export_csv,
    read_parquet_table,
    read_sheet,
    sql_extract,
    warehouse_extract,
    write_export_csv,
    write_table,
)

__all__ = [
    "clean_names",
    "literal_table",
    "number_rows",
    "read_csv_table",
    "read_export_csv",
    "read_parquet_table",
    "read_sheet",
    "sql_extract",
    "warehouse_extract",
    "write_export_csv",
    "write_table",
]
