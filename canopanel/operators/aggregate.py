"""Means, climatologies and the other grouped summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopanel.cluster import small_side
from canopanel.functions.calendar import season


def mean_by(table: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean of each value column per group; NULLs are skipped."""
    return table.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def seasonal_mean(panel: DataFrame, keys: Sequence[str], value: str = "value",
                  time: str = "time") -> DataFrame:
    """Mean over time per group and season."""
    return mean_by(panel.withColumn("season", season(F.month(time))), [*keys, "season"], [value])


def climatology(panel: DataFrame, keys: Sequence[str] = ("gridcell",), value: str = "value",
                time: str = "time") -> DataFrame:
    """Monthly mean and population standard deviation per group, over the rows given."""
    return panel.groupBy(*keys, F.month(time).alias("month")).agg(
        F.avg(value).alias("clim_mean"), F.stddev_pop(value).alias("clim_std"))


def area_mean(
    panel: DataFrame,
    weights: DataFrame,
    keys: Sequence[str] = ("member", "time"),
    values: Sequence[str] = ("value",),
    cell: str = "gridcell",
    weight: str = "landarea",
    scale_factor: float = 1.0,
    denominator: str = "selected",
    weights_where_present: bool = False,
    selected: DataFrame | None = None,
) -> DataFrame:
    """Area-weighted mean over cells: ``scale_factor * sum(v * w) / sum(w)``.

    ``denominator="selected"`` divides by the weights of all selected cells, whether or not a
    group of a sparse panel has a row of each; the selection is ``selected`` (cells, and those
    of ``keys`` that tell several selections apart) or else all cells of the panel, which costs
    a pass.  ``"rows"`` sums the weights of the group's own rows, ``"all"`` those of every cell
    in ``weights``.  A missing value leaves the numerator but keeps its weight, unless
    ``weights_where_present``, which looks at the group's own rows.
    """
    if denominator not in ("selected", "rows", "all"):
        raise ValueError("denominator must be 'selected', 'rows' or 'all'")
    w = F.col(weight)
    area = small_side(weights.select(cell, weight))
    joined = panel.join(area, cell)
    if denominator == "selected" and not weights_where_present:
        chosen = panel.select(cell) if selected is None else selected
        own = [k for k in keys if k in chosen.columns]
        totals = chosen.select(*own, cell).distinct().join(area, cell).groupBy(*own).agg(F.sum(weight).alias("_all"))
        joined = joined.join(small_side(totals), own) if own else joined.withColumn("_all", totals.select("_all").scalar())
    elif denominator == "all":
        joined = joined.withColumn("_all", weights.agg(F.sum(weight).alias("w")).scalar())

    def one(v: str):
        if weights_where_present and denominator != "all":
            total = F.sum(F.when(F.col(v).isNotNull(), w))
        elif denominator == "rows":
            total = F.sum(w)
        else:
            total = F.max("_all")
        return (scale_factor * F.try_divide(F.sum(F.col(v) * w), total)).alias(v)

    return joined.groupBy(*keys).agg(*[one(v) for v in values])


def trend_by(pred: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean and sample standard deviation of each column per group."""
    aggs = []
    for v in values:
        aggs += [F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_std")]
    return pred.groupBy(*keys).agg(*aggs)


def uncertainty_by(pred: DataFrame, keys: Sequence[str], alea: str = "alea",
                   epis: str = "epis") -> DataFrame:
    """Mean aleatoric, epistemic and total uncertainty per group."""
    return pred.groupBy(*keys).agg(
        F.avg(alea).alias("alea"), F.avg(epis).alias("epis"),
        F.avg(F.col(alea) + F.col(epis)).alias("total"))


def peak_trough(means: DataFrame, slice_col: str, values: Sequence[str]) -> DataFrame:
    """Slice of the largest and of the smallest mean; the first slice wins a tie.

    ``slice_col`` must be numeric.
    """
    earlier = -F.col(slice_col)
    aggs = []
    for v in values:
        aggs.append(F.max_by(slice_col, F.when(F.col(v).isNotNull(), F.struct(v, earlier))).alias(f"{v}_peak"))
        aggs.append(F.min_by(slice_col, F.when(F.col(v).isNotNull(), F.struct(v, slice_col))).alias(f"{v}_trough"))
    return means.agg(*aggs)


def column_bounds(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: name, min, max, mean (one pass over the table)."""
    one = table.agg(*[F.struct(
        F.lit(c).alias("name"), F.min(c).cast("double").alias("lo"),
        F.max(c).cast("double").alias("hi"), F.avg(c).alias("mean")).alias(c) for c in columns])
    return one.select(F.inline(F.array(*columns)))


def target_variance(table: DataFrame, outputs: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Population variance of each target column."""
    return table.groupBy(*keys).agg(*[F.var_pop(c).alias(f"{c}_var") for c in outputs])


def distinct_values(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    return table.select(*columns).distinct()
