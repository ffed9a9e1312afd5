"""Sparse cells to a regular lat/lon grid, and distances between fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopanel.cluster import join_on_keys, small_side, small_values, stored
from canopanel.operators.region import Box, slice_box

POINTS_AT_ONCE = 4096  # grid points that are packed together, on average at most
SALTS = 16


def nearest_label(x: Column, labels: Sequence[float]) -> Column:
    """The label closest to ``x``; of two equally close ones the larger.

    On a near enough regular axis the labels around the expected place are compared, on any other
    the two that a bisection ends between.
    """
    known = sorted(float(v) for v in labels)
    axis = F.expr(f"array({', '.join(f'{v!r}D' for v in known)})")  # one literal, however long
    step = (known[-1] - known[0]) / (len(known) - 1) if len(known) > 1 else 0.0
    if step > 0 and all(abs(v - known[0] - i * step) < step / 4 for i, v in enumerate(known)):
        at = F.round((x - known[0]) / step).cast("long")
        around = [F.get(axis, F.least(F.greatest(at + d, F.lit(0)), F.lit(len(known) - 1)).cast("int")) for d in (-1, 0, 1)]
        near = F.array(*around)
    else:
        at = _place(x, axis, len(known))
        near = F.array(*[F.get(axis, F.least(at + d, F.lit(len(known) - 1))) for d in (0, 1)])
    closest = F.array_min(F.transform(near, lambda a: F.struct(F.abs(a - x).alias("d"), (-a).alias("n"))))
    return F.when(x.isNotNull(), -closest["n"])


def _place(x: Column, axis: Column, n: int) -> Column:
    """The last of ``n`` ascending labels that is not over ``x``, or the first: log2(n) comparisons."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range((n - 1).bit_length()))]).cast("array<int>")
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when(
        (low + step < n) & (F.get(axis, low + step) <= x), low + step).otherwise(low))


def nearest_on_axes(table: DataFrame, grid: DataFrame, axes: Sequence[str] = ("lat", "lon"),
                    prefix: str = "nearest_") -> DataFrame:
    """Nearest grid label per axis, each axis on its own."""
    return table.withColumns({
        f"{prefix}{a}": nearest_label(F.col(a), small_values(grid, a)) for a in axes})


def cell_classes(grid: DataFrame, cluster: DataFrame, cell: str = "gridcell") -> DataFrame:
    """The cell that stands for each cluster class.

    A cell's class is the cluster centre at its nearest grid point; of several cells with
    one class the last wins.
    """
    at_nearest = nearest_on_axes(grid, cluster)
    centres = small_side(cluster.select(
        F.col("lat").alias("nearest_lat"), F.col("lon").alias("nearest_lon"),
        F.col("rcent").alias("cclass")).where(F.col("rcent").isNotNull()))
    return (at_nearest.join(centres, ["nearest_lat", "nearest_lon"])
            .groupBy("cclass").agg(F.max(cell).alias(cell)))


def regrid(values: DataFrame, grid: DataFrame, cluster: DataFrame, value: str = "value",
           dims: Sequence[str] = (), cell: str = "gridcell", box: Box | None = None) -> DataFrame:
    """Spread each cell's value over all lat/lon points of its class: (dims, lat, lon, value).

    Points without a class are kept with a NULL value.  With ``box`` only the points inside
    are produced.  Reduce the dims first where possible: the output has one full grid per
    combination of ``dims``.

    A cell's points are packed into arrays of some thousands, and each frame's value of the cell is
    exploded to them.  Cells are few and each is met by every frame, so the arrays are repeated for
    a number of salts and frames spread over these.
    """
    dims = list(dims)
    points = slice_box(cluster, box) if box else cluster
    points = points.select("lat", "lon", "cclass").join(
        small_side(cell_classes(grid, cluster, cell)), "cclass", "left")
    if not dims:
        return points.join(values.select(cell, value), cell, "left").select("lat", "lon", value)
    points = stored(points.select("lat", "lon", cell), "points")
    values = stored(values.select(*dims, cell, value), "values")
    chunks = max(1, -(-points.count() // POINTS_AT_ONCE))
    packed = points.groupBy(cell, F.pmod(F.xxhash64("lat", "lon"), F.lit(chunks)).alias("_chunk")).agg(
        F.collect_list(F.struct("lat", "lon")).alias("_points")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # Each frame with all cells of the grid's classes, and once for the points without one.
    cells = F.array(*[F.lit(c) for c in small_values(points, cell)], F.lit(None)).cast(T.ArrayType(values.schema[cell].dataType))
    frames = values.select(*dims).distinct().withColumn(cell, F.explode(cells))
    full = frames.join(values, [*dims, cell], "left").withColumn("_salt", F.pmod(F.xxhash64(*dims), F.lit(SALTS)).cast("int"))
    met = join_on_keys(full, packed.drop("_chunk"), [cell, "_salt"], "inner")
    return met.select(*dims, value, F.inline("_points")).select(*dims, "lat", "lon", value)


def field_distance(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("lat", "lon"),
                   value: str = "value", out: str = "distance") -> DataFrame:
    """Absolute difference of two fields at the same points."""
    right = b.select(*keys, F.col(value).alias("_other"))
    return a.join(right, list(keys)).select(*keys, F.abs(F.col(value) - F.col("_other")).alias(out))
