"""Schemas of the library's tables and the checks made before a job starts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PANEL = T.StructType([
    T.StructField("member", T.LongType()),
    T.StructField("time", T.DateType()),
    T.StructField("gridcell", T.IntegerType()),
    T.StructField("value", T.FloatType()),
])

GRID = T.StructType([
    T.StructField("gridcell", T.IntegerType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("lat", T.DoubleType()),
])

OBSERVED = T.StructType([
    T.StructField("step", T.IntegerType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("lai", T.FloatType()),
])


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Raise ``KeyError`` on the driver when a column is missing; else return ``df``."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns {missing}; table has {df.columns}")
    return df


def params_schema(names: Iterable[str], member_type: T.DataType | None = None) -> T.StructType:
    """Schema of a parameter table: the member id and one double per parameter."""
    fields = [T.StructField("member", member_type or T.LongType())]
    return T.StructType(fields + [T.StructField(n, T.DoubleType()) for n in names])


def nan_to_null(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Turn NaN into NULL in floating columns, so that ``avg`` and ``max`` skip it."""
    wanted = set(columns if columns is not None else df.columns)
    floating = [
        f.name for f in df.schema.fields
        if f.name in wanted and isinstance(f.dataType, (T.FloatType, T.DoubleType))
    ]
    return df.withColumns({
        c: F.when(~F.isnan(c), F.col(c)) for c in floating
    }) if floating else df


def to_float32(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Store columns as 32-bit floats (aggregates still run in double)."""
    return df.withColumns({c: F.col(c).cast("float") for c in columns})
