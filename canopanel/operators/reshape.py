"""From arrays to tables and back: stacking, spreading, attaching, concatenating."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopanel.cluster import small_side
from canopanel.functions.calendar import month_cos, month_sin
from canopanel.operators.ranking import axis_index
from canopanel.schema import require_columns


def stack_samples(panel: DataFrame, dims: Sequence[str] = ("member", "time", "gridcell"),
                  out: str = "sample_id") -> DataFrame:
    """Number the samples as a dense array of these dims would: row-major, from 0.

    The id comes from each dim's own index table, so the panel itself is never sorted.  A row
    with a NULL dim keeps its place in the table and has no id.
    """
    result, sample = panel, F.lit(0).cast("long")
    for dim in dims:
        index = axis_index(panel, dim, f"_{dim}")
        result = result.join(index, dim, "left")
        sample = sample * F.lit(index.count()) + F.col(f"_{dim}")
    return result.withColumn(out, sample).drop(*[f"_{d}" for d in dims])


def sample_slice(samples: DataFrame, sample: int, sample_id: str = "sample_id") -> DataFrame:
    """One sample by its id (physical row order means nothing in a table)."""
    return samples.where(F.col(sample_id) == sample)


def sample_of(panel: DataFrame, sample: int, dims: Sequence[str] = ("member", "time", "gridcell")) -> DataFrame:
    """The rows of one sample by the id that :func:`stack_samples` would give it.

    The id is turned back into its labels, so only the index tables are numbered, not the rows.
    """
    rows = panel
    for dim in reversed(dims):
        index = axis_index(panel, dim, f"_{dim}")
        sample, at = divmod(sample, max(index.count(), 1))
        rows = rows.where(F.col(dim) == index.where(F.col(f"_{dim}") == at).select(dim).scalar())
    return rows if sample == 0 else rows.limit(0)


def stack_multitask(panel: DataFrame, cells: Sequence, keys: Sequence[str] = ("member", "time"),
                    cell: str = "gridcell", value: str = "value", prefix: str = "cell_") -> DataFrame:
    """One row per sample with one output column per cell; absent cells are NULL.

    The rows are brought together by sample before the pivot.  Otherwise each task would
    send a full-width, mostly empty row for every sample it has seen a part of.
    """
    together = panel.select(*keys, cell, value).repartition(*keys)
    wide = together.groupBy(*keys).pivot(cell, list(cells)).agg(F.max(value))
    return wide.withColumnsRenamed({str(c): f"{prefix}{c}" for c in cells})


def unstack_tasks(wide: DataFrame, keys: Sequence[str], cells: Sequence, cell: str = "gridcell",
                  value: str = "value", prefix: str = "cell_", dense: bool = False) -> DataFrame:
    """Back to one row per (sample, cell); ``dense`` keeps absent cells as NULL rows."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias(cell), F.col(f"{prefix}{c}").alias(value)) for c in cells])
    rows = wide.select(*keys, F.inline(pairs))
    return rows if dense else rows.where(F.col(value).isNotNull())


def unstack_array(table: DataFrame, keys: Sequence[str], array: str, cells: Sequence,
                  cell: str = "gridcell", value: str = "value") -> DataFrame:
    """Rows from an array column whose i-th entry belongs to ``cells[i]``."""
    ids = F.array(*[F.lit(c) for c in cells])
    return table.select(*keys, F.posexplode(array).alias("_i", value)).select(
        *keys, F.element_at(ids, F.col("_i") + 1).alias(cell), value)


def features_long(table: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """One row per (sample, feature)."""
    return table.select(*keys, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        list(keys), list(features), "feature", "value")


def feature_vector(table: DataFrame, features: Sequence[str], out: str = "x") -> DataFrame:
    """Features as one array in the given order, for a model's input."""
    return table.withColumn(out, F.array(*[F.col(f).cast("double") for f in features]))


def with_time_features(table: DataFrame, time: str = "time", cyclic: bool = True) -> DataFrame:
    """Year, month and, if ``cyclic``, the month's sine and cosine."""
    table = table.withColumns({"year": F.year(time), "month": F.month(time)})
    if not cyclic:
        return table
    return table.withColumns({"m_sin": month_sin(F.col("month")), "m_cos": month_cos(F.col("month"))})


def _attach(table: DataFrame, other: DataFrame, keys: Sequence[str], how: str, what: str) -> DataFrame:
    """Join ``other`` to ``table`` on keys.

    ``"strict"`` fails while rows are computed, in the same pass: at a row without a match and
    at keys that ``other`` has twice.  ``"left"`` keeps unmatched rows with NULLs, ``"inner"``
    drops them, and both repeat rows where keys repeat.
    """
    keys = list(keys)
    if how != "strict":
        return table.join(other, keys, how)
    checked = other.withColumn("_times", F.count("*").over(Window.partitionBy(*keys)))
    joined = table.join(checked, keys, "left")
    row = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in keys])
    fault = F.when(F.col("_times").isNull(), F.concat(F.lit(f"no {what} for "), row)).when(
        F.col("_times") > 1, F.concat(F.lit(f"several {what} for "), row))
    kind = table.schema[keys[0]].dataType
    # The check is part of a key, which no later selection leaves out unnoticed.
    return joined.withColumn(keys[0], F.when(fault.isNull(), F.col(keys[0])).otherwise(
        F.raise_error(fault).cast(kind))).drop("_times")


def attach_params(panel: DataFrame, params: DataFrame, member: str = "member", how: str = "strict") -> DataFrame:
    """Each member's parameters on each of its rows; ``how`` as in :func:`_attach`."""
    return _attach(panel, small_side(params), [member], how, "parameters")


def attach_forcing(panel: DataFrame, forcing: DataFrame,
                   keys: Sequence[str] = ("time", "gridcell"), how: str = "strict") -> DataFrame:
    """The forcing of the row's time and cell; Spark chooses the join from the sizes."""
    return _attach(panel, forcing, keys, how, "forcing")


def x_input(params: DataFrame, first: str, last: str, cyclic: bool = True) -> DataFrame:
    """Every parameter row at every month from ``first`` to ``last`` (dates, inclusive).

    The months are generated from each row, so parameters and months cannot be misaligned.
    """
    months = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month"))
    return with_time_features(params.withColumn("time", F.explode(months)), cyclic=cyclic)


def densify(panel: DataFrame, axes: Mapping[str, Sequence], keys: Sequence[str]) -> DataFrame:
    """All combinations of ``keys[0]``'s values with the given axis values; absent rows are NULL.

    ``keys`` names the dims in order; every dim but the first needs an entry in ``axes``.
    """
    full = panel.select(keys[0]).distinct()
    for dim in keys[1:]:
        kind = panel.schema[dim].dataType
        full = full.withColumn(dim, F.explode(F.array(*[F.lit(v).cast(kind) for v in axes[dim]])))
    return full.join(panel, list(keys), "left")


def concat(tables: Sequence[DataFrame], fill: bool = False) -> DataFrame:
    """Stack tables by column name; ``fill`` allows differing columns (absent ones are NULL)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=fill), tables)


def unify_slices(tables: Mapping[str, DataFrame], columns: Sequence[str], slice_col: str = "slice",
                 separator: str = "_") -> DataFrame:
    """Concatenate tables whose columns carry their slice's prefix (``jan_mu``, ``feb_mu``)."""
    same = []
    for name, table in tables.items():
        renamed = table.withColumnsRenamed({f"{name}{separator}{c}": c for c in columns})
        same.append(renamed.withColumn(slice_col, F.lit(name)))
    return concat(same)


def attach_predictions(truth: DataFrame, pred: DataFrame, keys: Sequence[str], how: str = "strict") -> DataFrame:
    """Truth and prediction side by side, matched on keys; ``how`` as in :func:`_attach`."""
    require_columns(truth, keys)
    require_columns(pred, keys)
    return _attach(truth, pred, keys, how, "prediction")


def align_xy(x: DataFrame, y: DataFrame, keys: Sequence[str], strict: bool = True) -> DataFrame:
    """Features and target matched on keys; ``strict`` fails at a sample that only one side has.

    One full outer join finds both kinds of samples while rows are computed.
    """
    keys = list(keys)
    if not strict:
        return x.join(y, keys)
    both = x.withColumn("_x", F.lit(True)).join(y.withColumn("_y", F.lit(True)), keys, "full_outer")
    row = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
    fault = F.when(F.col("_y").isNull(), F.concat(F.lit("no target for sample "), row)).when(
        F.col("_x").isNull(), F.concat(F.lit("no features for sample "), row))
    return both.withColumn(keys[0], F.when(fault.isNull(), F.col(keys[0])).otherwise(
        F.raise_error(fault).cast(x.schema[keys[0]].dataType))).drop("_x", "_y")


def assemble_inputs(sampled: DataFrame, baseline: DataFrame, features: Sequence[str]) -> DataFrame:
    """Sampled parameters plus a one-row baseline held constant, in the model's feature order."""
    held = baseline.columns
    others = [c for c in sampled.columns if c not in features]
    row = sampled.withColumn("_held", baseline.select(F.struct(*held)).scalar())
    return row.select(*others, *[
        F.col(f"_held.{f}").alias(f) if f in held else F.col(f) for f in features])
