"""INSERT, UPDATE and DELETE as the next version of an immutable table."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def insert(df: DataFrame, values: tuple[Any, ...]) -> DataFrame:
    """One more row. Its values must fit the columns in number, type and nullability."""
    if len(values) != len(df.schema.fields):
        raise ValueError(f"expected {len(df.schema.fields)} values, got {len(values)}")
    fits = {T.IntegerType: int, T.LongType: int, T.ShortType: int, T.StringType: str, T.BooleanType: bool, T.DoubleType: float}
    for field, value in zip(df.schema.fields, values, strict=True):
        want = fits.get(type(field.dataType))
        if value is None and not field.nullable:
            raise ValueError(f"null in column {field.name}")
        if value is not None and want and type(value) is not want:
            raise TypeError(f"column {field.name}: {value!r} is no {field.dataType.simpleString()}")
    return df.unionByName(df.sparkSession.createDataFrame([values], df.schema))


def delete(df: DataFrame, where: Column | None = None) -> DataFrame:
    """Rows that stay: those for which the condition is false or null."""
    return df.filter(F.lit(False)) if where is None else df.filter(~F.coalesce(where, F.lit(False)))


def update(df: DataFrame, assign: Mapping[str, Column], where: Column | None = None) -> DataFrame:
    """All assignments see the old row: one select, never a chain of withColumn."""
    unknown = set(assign) - set(df.columns)
    if unknown:
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return df.select(*[
        F.when(hit, assign[f.name].cast(f.dataType)).otherwise(df[f.name]).alias(f.name) if f.name in assign else df[f.name]
        for f in df.schema.fields
    ])


def affected(df: DataFrame, where: Column | None = None) -> DataFrame:
    """How many rows a change touches, as a one-row DataFrame."""
    return (df if where is None else df.filter(where)).agg(F.count("*").alias("affected"))
