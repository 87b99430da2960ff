"""Sources and sinks: tables from files, catalogs and frames; results to pandas, files and catalogs."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession

from verbena.table import Tbl, verb

FORMATS = ("parquet", "csv", "json", "orc", "text", "jdbc", "avro", "delta")


def read_table(spark: SparkSession, path: str | None = None, format: str = "parquet", schema: Any = None, **options: Any) -> Tbl:
    """A table from files (or JDBC); filters and column choices of later verbs reach the scan."""
    if format not in FORMATS:
        raise ValueError(f"format {format!r}; use one of {', '.join(FORMATS)}")
    reader = spark.read.format(format).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    elif format == "csv":
        reader = reader.option("header", options.get("header", True)).option("inferSchema", options.get("inferSchema", True))
    return Tbl(reader.load(path) if path is not None else reader.load())


@verb
def write_table(t: Tbl, /, path: str | None = None, format: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None, table: str | None = None, **options: Any) -> Tbl:
    """Write to files or a catalog table; gives the table on."""
    writer = t.to_spark().write.format(format).mode(mode).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(table) if table else writer.save(path)
    return t


@verb
def collect(t: Tbl, /) -> Any:
    """Run the query; a pandas frame on the driver."""
    return t.to_spark().toPandas()


@verb
def show_query(t: Tbl, /, simplify: bool = False, return_table: bool = True) -> Any:
    """Print Spark's plan; gives the table on."""
    t.to_spark().explain(mode="simple" if simplify else "formatted")
    return t if return_table else None


def load_dataset(spark: SparkSession, name: str) -> Tbl:
    """A small packaged table: rows are in code, so no file has to reach the executors."""
    if name not in PACKAGED:
        raise KeyError(f"no dataset {name!r}; there are {', '.join(PACKAGED)}")
    columns, rows = PACKAGED[name]
    return Tbl(spark.createDataFrame(rows, columns))


#: Well-known example tables: fixed values.
PACKAGED: dict[str, tuple[str, list[tuple]]] = {
    "band_members": ("name string, band string", [("Mick", "Stones"), ("John", "Beatles"), ("Paul", "Beatles")]),
    "band_instruments": ("name string, plays string", [("John", "guitar"), ("Paul", "bass"), ("Keith", "guitar")]),
    "band_instruments2": ("artist string, plays string", [("John", "guitar"), ("Paul", "bass"), ("Keith", "guitar")]),
}
