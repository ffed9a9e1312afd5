"""Moments that can be merged: means and deviations of a table that grows, without reading it again.

A table of moments has per group and column the number of values, their mean and the sum of
squared distances from it.  Tables of disjoint rows are merged by the parallel formula (Chan,
Golub & LeVeque 1983), so a year's new months are read once and added to what is stored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moments(table: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, feature, n, mean, m2) of each column; missing values are not counted."""
    sums = [F.struct(
        F.lit(c).alias("feature"), F.count(c).alias("n"), F.avg(c).alias("mean"),
        (F.var_pop(c) * F.count(c)).alias("m2")) for c in columns]
    wide = table.groupBy(*keys).agg(F.array(*sums).alias("_m"))
    return wide.select(*keys, F.inline("_m")).where("n > 0")


def merged(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """The moments of all rows behind several tables of moments, whose rows must be disjoint."""
    both = reduce(lambda a, b: a.unionByName(b), tables)
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    parts = F.collect_list(F.struct("n", "mean", "m2"))  # one for each table
    wide = both.groupBy(*keys, "feature").agg(n.alias("n"), mean.alias("mean"), parts.alias("_p"))
    spread = F.aggregate("_p", F.lit(0.0), lambda total, p: total + p["m2"] + p["n"] * F.pow(p["mean"] - F.col("mean"), 2))
    return wide.select(*keys, "feature", "n", "mean", spread.alias("m2"))


def update(saved: DataFrame, new_rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Stored moments with those of rows they do not have yet: only the new rows are read."""
    return merged([saved, moments(new_rows, keys, columns)], keys)


def to_climatology(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, clim_mean, clim_std) of moments of one column by ``keys``, which have the month."""
    return table.select(*keys, F.col("mean").alias("clim_mean"), F.sqrt(F.col("m2") / F.col("n")).alias("clim_std"))


def to_scaler(table: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """What ``fit_standard`` gives: ``<c>_mean`` and ``<c>_std`` of each column (and group)."""
    std = F.sqrt(F.col("m2") / F.col("n"))
    return table.groupBy(*by).agg(*[
        F.max(F.when(F.col("feature") == c, value)).alias(f"{c}_{name}")
        for c in columns for name, value in (("mean", F.col("mean")), ("std", std))])
