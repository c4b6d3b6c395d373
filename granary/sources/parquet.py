"""Parquet tables of one data folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.session import shared_folder

RELATIONAL = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
TABLES = (
    *RELATIONAL, "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
#: Bytes of rows in a range of a clustered layout; one task sorts them in memory.
RANGE_BYTES = 64 << 20
#: Up to so many ranges (spark.shuffle.sort.bypassMergeThreshold) a task deals its rows to files as it reads them; beyond, it holds
#: those of its whole split. So ranges take up to 8 times the bytes before there are more of them.
DIRECT_RANGES = 200


def scan(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """Sequential scan. Column pruning and filters reach the reader through Catalyst."""
    if table not in TABLES:
        raise ValueError(f"unknown table: {table}")
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def register(spark: SparkSession, folder: str, tables: tuple[str, ...] = TABLES) -> None:
    """Temp views, so that spark.sql() sees the folder's tables by name."""
    for table in tables:
        scan(spark, folder, table).createOrReplaceTempView(table)


def row_bytes(df: DataFrame) -> Column:
    """About the bytes a row takes in memory: some of its own, eight a column, and what strings and nested values hold."""
    size = F.lit(16 + 8 * len(df.columns)).cast("bigint")
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size += F.coalesce(F.octet_length(df[f.name]), F.lit(0))
        elif not isinstance(f.dataType, T.AtomicType):
            size += F.coalesce(F.octet_length(F.to_json(df[f.name])), F.lit(0))
    return size


def ranges(df: DataFrame, least: int) -> int:
    """How many ranges df's rows need, so that none grows with the table."""
    size = df.agg(F.sum(row_bytes(df))).first()[0] or 0
    return max(least, min(-(-size // RANGE_BYTES), DIRECT_RANGES), -(-size // (8 * RANGE_BYTES)))


def write_clustered(df: DataFrame, path: str, keys: list[str], files: int) -> None:
    """CREATE INDEX as a layout: ranges of the key in separate files, sorted within; at least the given number, more as the table grows.

    Parquet's min/max statistics then let a lookup or a range scan skip row groups.
    Nulls come first, as in the dialect's index order. A key with many rows may go over several files; a hash of the row tells where.
    """
    order = [df[k].asc_nulls_first() for k in keys]
    row = F.xxhash64(*[df[f.name] for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)])
    df.repartitionByRange(ranges(df, files), *order, row).sortWithinPartitions(*order).write.mode("errorifexists").parquet(path)


def clustered(df: DataFrame, keys: list[str], files: int) -> DataFrame:
    """The rows of df in a clustered layout of their own, from which lookups by the key read only the row groups that may have it."""
    path = f"{shared_folder(df.sparkSession)}/granary/index-{uuid.uuid4().hex}"
    write_clustered(df, path, keys, files)
    return df.sparkSession.read.schema(df.schema).parquet(path)
