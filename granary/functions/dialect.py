"""Where the dialect's arithmetic and logic differ from ANSI Spark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(x: Column | str | int) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def int_div(a: Column | str | int, b: Column | str | int) -> Column:
    """Integer division, truncated toward zero; null if b is 0 or either side is null."""
    return F.call_function("div", _column(a), F.nullif(_column(b), F.lit(0)))


def int_avg(x: Column | str) -> Column:
    """Average of an integer column, truncated toward zero; nulls don't count; null for no rows."""
    x = _column(x)
    return F.call_function("div", F.sum(x), F.nullif(F.count(x), F.lit(0)))


def strict_and(a: Column, b: Column) -> Column:
    """AND that is null as soon as either side is null. It hides its sides from pushdown: use & unless this is wanted."""
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).otherwise(a & b)


def strict_or(a: Column, b: Column) -> Column:
    """OR that is null as soon as either side is null; see strict_and."""
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).otherwise(a | b)
