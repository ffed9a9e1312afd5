"""Scalers: fitted on training rows, stored as small tables, applied anywhere."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopanel.cluster import small_side
from canopanel.operators.ranking import exact_quantiles


def fit_standard(train: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and population standard deviation per column: ``<c>_mean``, ``<c>_std``."""
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    return train.groupBy(*by).agg(*aggs)


def _with_moments(table: DataFrame, moments: DataFrame, by: Sequence[str]):
    """``table`` and the column expression of a moment by its name.

    Moments of groups are joined; those of the whole table, one row, are literals: a row that carried
    them all would be written out with them.
    """
    if by:
        packed = F.struct(*[c for c in moments.columns if c not in by]).alias("_m")
        return table.join(small_side(moments.select(*by, packed)), list(by), "left"), lambda name: F.col(f"_m.{name}")
    rows = moments.limit(2).collect()
    if len(rows) > 1:
        raise ValueError("moments of the whole table must be one row")
    return table, lambda name: F.lit(rows[0][name] if rows else None).cast(moments.schema[name].dataType)


def _spread(std: Column) -> Column:
    return F.when(std == 0, 1.0).otherwise(std)


def standard_scale(table: DataFrame, moments: DataFrame, columns: Sequence[str],
                   by: Sequence[str] = (), suffix: str = "") -> DataFrame:
    """``(x - mean) / std``; a constant column is only centred."""
    table, of = _with_moments(table, moments, by)
    return table.withColumns({
        f"{c}{suffix}": (F.col(c) - of(f"{c}_mean")) / _spread(of(f"{c}_std")) for c in columns}).drop("_m")


def inverse_scale(table: DataFrame, moments: DataFrame, columns: Sequence[str],
                  by: Sequence[str] = (), suffix: str = "") -> DataFrame:
    """``x * std + mean``."""
    table, of = _with_moments(table, moments, by)
    return table.withColumns({
        f"{c}{suffix}": F.col(c) * _spread(of(f"{c}_std")) + of(f"{c}_mean") for c in columns}).drop("_m")


def fit_quantiles(train: DataFrame, columns: Sequence[str], n_quantiles: int = 1000) -> DataFrame:
    """Quantile table (feature, k, ref, quantile) with ``ref = k / (n_quantiles - 1)``, exact over all rows."""
    parts = n_quantiles - 1
    return exact_quantiles(train, columns, parts).withColumn("ref", F.col("k") / F.lit(float(parts)))


def save_scaler(fitted: DataFrame, path: str) -> None:
    """A fitted scaler, of either kind, as a Parquet table."""
    fitted.write.mode("overwrite").parquet(path)


def load_scaler(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def quantile_scale(table: DataFrame, quantiles: DataFrame, columns: Sequence[str],
                   suffix: str = "") -> DataFrame:
    """Map each column to [0, 1] through its quantile table; outside values are clipped.

    Only the quantile table (features x n_quantiles rows, chosen by the caller) is
    collected.  A value shared by several quantiles gets the middle of their refs.
    """
    wanted = list(columns)
    fitted = defaultdict(list)
    for r in quantiles.where(F.col("feature").isin(wanted)).orderBy("feature", "k").collect():
        fitted[r["feature"]].append((r["quantile"], r["ref"]))
    missing = [c for c in wanted if c not in fitted]
    if missing:
        raise KeyError(f"no quantiles for {missing}")

    def mapper(points: list[tuple[float, float]]):
        q, ref = (np.asarray(a, dtype=float) for a in zip(*points))

        @F.pandas_udf(T.DoubleType())
        def to_uniform(x: pd.Series) -> pd.Series:
            v = x.to_numpy(dtype=float, na_value=np.nan)
            upper = np.interp(v, q, ref)
            lower = -np.interp(-v, -q[::-1], -ref[::-1])
            result = 0.5 * (upper + lower)
            result = np.where(v >= q[-1], ref[-1], result)
            result = np.where(v <= q[0], ref[0], result)
            return pd.Series(np.where(np.isnan(v), np.nan, result)).where(~np.isnan(v))

        return to_uniform

    return table.withColumns({
        f"{c}{suffix}": mapper(fitted[c])(F.col(c).cast("double")) for c in wanted})
