"""Anomalies: values compared with their own group's mean.

A window over the group would bring all rows of one cell into one task.  The group's mean
is therefore aggregated first (with map-side partial sums) and joined back, where Spark can
split a skewed partition.  Rows with a NULL key get a NULL anomaly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopanel.cluster import small_side, stored
from canopanel.functions.calendar import in_period
from canopanel.operators.aggregate import climatology

ZSCORE_EPSILON = 1e-9


def time_mean_anomaly(panel: DataFrame, keys: Sequence[str] = ("member", "gridcell"),
                      value: str = "value", out: str = "anomaly") -> DataFrame:
    """Value minus the mean of its group over time.

    The means are stored first: Spark then knows their size, broadcasts them when they are
    small, and otherwise joins by the keys.
    """
    means = stored(panel.groupBy(*keys).agg(F.avg(value).alias("_mean")), "means")
    return (panel.join(means, list(keys), "left")
            .withColumn(out, F.col(value) - F.col("_mean")).drop("_mean"))


def anomaly(
    panel: DataFrame,
    mode: str | None = None,
    baseline: tuple[str, str] | None = None,
    period: tuple[str, str] | None = None,
    keys: Sequence[str] = ("gridcell",),
    value: str = "value",
    time: str = "time",
    out: str = "anomaly",
    base: DataFrame | None = None,
) -> DataFrame:
    """Raw values (``None``), climatology anomalies (``"clim"``) or z-scores (``"zscore"``).

    The monthly climatology comes from ``baseline``; the output covers ``period``, which
    may differ.  A month without baseline rows gives NULL.  Where the caller has cut the
    baseline from the panel already, ``base`` holds it.
    """
    if mode not in (None, "clim", "zscore"):
        raise ValueError(f"unknown anomaly mode {mode!r}")
    shown = panel.where(in_period(F.col(time), *period)) if period else panel
    if mode is None:
        return shown.withColumn(out, F.col(value))
    base = panel if base is None else base
    base = base.where(in_period(F.col(time), *baseline)) if baseline else base
    stats = small_side(climatology(base, keys, value, time))
    joined = shown.withColumn("month", F.month(time)).join(stats, [*keys, "month"], "left")
    difference = F.col(value) - F.col("clim_mean")
    if mode == "zscore":
        difference = difference / (F.col("clim_std") + ZSCORE_EPSILON)
    return joined.withColumn(out, difference).drop("clim_mean", "clim_std", "month")
