"""Filter, projection, joins, aggregation, keyed lookup and range scan.

Each is a thin declaration; Catalyst picks the physical plan (pushdown, pruning,
broadcast or sort-merge join, partial aggregation).
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JOIN_KINDS = ("inner", "left")


def keep(df: DataFrame, condition: Column) -> DataFrame:
    """WHERE: rows for which the condition is true; null drops the row."""
    return df.filter(condition)


def project(df: DataFrame, **columns: Column) -> DataFrame:
    """SELECT with a name for each output column."""
    return df.select(*[c.alias(name) for name, c in columns.items()])


def join(left: DataFrame, right: DataFrame, on: Column, kind: str = "inner") -> DataFrame:
    """INNER or LEFT join on any boolean condition. Equalities within it become hash or merge keys."""
    if kind not in JOIN_KINDS:
        raise ValueError(f"unsupported join: {kind}")
    return left.join(right, on, kind)


def star(joined: DataFrame, **tables: DataFrame) -> DataFrame:
    """SELECT * over a join of aliased tables: all columns in order, each led by its table's alias, so that equal names stay apart."""
    return joined.select(*[F.col(f"{alias}.{c}").alias(f"{alias}_{c}") for alias, df in tables.items() for c in df.columns])


def aggregate(df: DataFrame, by: Sequence[Column] = (), having: Column | None = None, **columns: Column) -> DataFrame:
    """GROUP BY with HAVING over the output names. Without keys: one row, also for an empty input."""
    if not columns:
        raise ValueError("no aggregate given")
    out = df.groupBy(*by).agg(*[c.alias(name) for name, c in columns.items()])
    return out if having is None else out.filter(having)


def lookup(df: DataFrame, key: str, value: Any) -> DataFrame:
    """Rows whose key equals the value: an equality that reaches the Parquet reader."""
    return df.filter(df[key] == value)


def range_scan(df: DataFrame, key: str, start: Any = None, end: Any = None) -> DataFrame:
    """Rows with start <= key < end; a missing bound is open. Without bounds null keys stay, as in a full index scan."""
    if start is not None:
        df = df.filter(df[key] >= start)
    return df if end is None else df.filter(df[key] < end)
