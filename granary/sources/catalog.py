"""The three catalog tables of the dialect, rendered from DataFrame schemas (no data is read)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

def create_table(spark: SparkSession, name: str, schema: str, location: str | None = None) -> DataFrame:
    """CREATE TABLE: an empty Parquet table of Spark's catalog; a name that is taken is an error, as are equal column names."""
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet{where}")
    return spark.table(name)


PG_CLASS = "table_id int, name string, first_page_id int"
PG_ATTRIBUTE = "table_id int, column_name string, data_type int, nullable boolean, ordinal_position int"
PG_INDEX = "index_id int, index_name string, table_id int, column_ids string, root_page_id int"
#: The dialect's type codes. Types it lacks have the code null.
TYPE_CODES = {"int": 0, "string": 1, "boolean": 2}


def pg_class(spark: SparkSession, tables: Mapping[str, T.StructType]) -> DataFrame:
    """One row per table. first_page_id is null: Parquet tables have no pages."""
    return spark.createDataFrame([(i, name, None) for i, name in enumerate(tables)], PG_CLASS)


def pg_attribute(spark: SparkSession, tables: Mapping[str, T.StructType]) -> DataFrame:
    """One row per column, in order."""
    rows = [
        (i, f.name, TYPE_CODES.get(f.dataType.simpleString()), f.nullable, k)
        for i, schema in enumerate(tables.values())
        for k, f in enumerate(schema.fields)
    ]
    return spark.createDataFrame(rows, PG_ATTRIBUTE)


def pg_index(spark: SparkSession, tables: Mapping[str, T.StructType], layouts: Mapping[str, tuple[str, list[str]]]) -> DataFrame:
    """One row per clustered layout; layouts: name -> (table, key columns)."""
    ids = {name: i for i, name in enumerate(tables)}
    rows = []
    for i, (name, (table, keys)) in enumerate(layouts.items()):
        names = tables[table].fieldNames()
        rows.append((i, name, ids[table], ",".join(str(names.index(k)) for k in keys), None))
    return spark.createDataFrame(rows, PG_INDEX)
