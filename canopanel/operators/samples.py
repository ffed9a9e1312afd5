"""The sample table of an emulator: features and target per (member, time, gridcell)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopanel.operators.anomaly import time_mean_anomaly
from canopanel.operators.region import select_cells, slice_time
from canopanel.operators.reshape import attach_forcing, attach_params, with_time_features

FORCING_FEATURES = ["tsa", "precip", "m_sin", "m_cos", "year"]


def build_samples(
    panel: DataFrame,
    params: DataFrame,
    forcing: DataFrame,
    cells: DataFrame | None = None,
    period: tuple[str, str] | None = None,
    keys: Sequence[str] = ("member", "time", "gridcell"),
    value: str = "value",
) -> DataFrame:
    """Features and target in one plan: (keys, target, <parameters>, tsa, precip, year, month, m_sin, m_cos).

    The target is the anomaly from the mean over the period per (member, cell); cells and
    period are cut before anything is computed.
    """
    keys = list(keys)
    values = panel.select(*keys, value)
    if cells is not None:
        values = select_cells(values, cells)
    if period is not None:
        values = slice_time(values, *period)
        forcing = slice_time(forcing, *period)
    weather = forcing.select("time", "gridcell", "tsa", (F.col("rain") + F.col("snow")).alias("precip"))
    target = time_mean_anomaly(values, ["member", "gridcell"], value, "target").drop(value)
    return with_time_features(attach_forcing(attach_params(target, params), weather))


def feature_names(params: DataFrame, member: str = "member") -> list[str]:
    return [c for c in params.columns if c != member] + FORCING_FEATURES
