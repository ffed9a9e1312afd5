"""Exact ranks and quantiles without sending a group to one task.

A window ordered over a whole group sorts that group in a single task.  Here the table is
range-partitioned by (group, order) instead, so a large group is spread over many
partitions, and stored.  Each (group, partition) is a block of consecutive ranks; the blocks
are few, and a running total over them gives every block its first rank.  Rows are then
looked at only inside the blocks that matter.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopanel.cluster import BROADCAST_ROWS, join_on_keys, small_side, small_values, stored

# Quantiles are bracketed by sketched ones this far to either side (as a share of the rows, and
# two rows more); the sketch is ten times as accurate, so a bracket cannot miss its ranks.
BRACKET = 1e-3
SKETCH_ACCURACY = 10_000
_GRID = 1000  # evenly spaced shares whose quantiles the sketch gives


def rank_blocks(table: DataFrame, by: Sequence[str], order: Sequence[str], weight: str | None = None,
                sums: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The stored rows, and their blocks (by, _part, _before, _size, _total, <sums>).

    A block covers the ranks ``_before`` + 1 .. ``_before`` + ``_size`` of its group, counted
    in the integer ``weight`` (1 when absent).  ``order`` must be unique within a group.
    Because the partitioned rows are stored, rows and blocks come from the same partitions
    even when a task is run again.
    """
    by = list(by)
    amount = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    rows = stored(
        table.repartitionByRange(*by, *order)
        .withColumns({"_part": F.spark_partition_id(), "_amount": amount}), "ranges")
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    blocks = rows.groupBy(*by, "_part").agg(
        F.sum("_amount").alias("_size"), *[F.sum(c).alias(c) for c in sums])
    return rows, blocks.withColumns({
        "_before": F.coalesce(F.sum("_size").over(
            group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")),
        "_total": F.sum("_size").over(group),
    })


def ranks_in(rows: DataFrame, blocks: DataFrame, by: Sequence[str], order: Sequence[str],
             some: bool = False) -> DataFrame:
    """The rows of the given blocks with ``_rank`` (running weight, inclusive) and ``_total``.

    With ``some`` the blocks are a selection, and files without any of them are not read.
    """
    by = list(by)
    if some:
        rows = rows.where(F.col("_part").isin(small_values(blocks, "_part")))
    within = (Window.partitionBy(*by, "_part").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = join_on_keys(rows, blocks.select(*by, "_part", "_before", "_total"), [*by, "_part"], "inner")
    return (placed.withColumn("_rank", F.col("_before") + F.sum("_amount").over(within))
            .drop("_part", "_before", "_amount"))


def running_total(table: DataFrame, by: Sequence[str], order: Sequence[str], weight: str | None = None,
                  out: str = "running", total: str = "total") -> DataFrame:
    """Inclusive running sum of an integer ``weight`` (1 when absent) within each group."""
    rows, blocks = rank_blocks(table, by, order, weight)
    return ranks_in(rows, blocks, by, order).withColumnsRenamed({"_rank": out, "_total": total})


def ranked(table: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "rank",
           total: str = "total") -> DataFrame:
    """``row_number`` (from 1) and group size for a unique order."""
    return running_total(table, by, order, None, out, total)


def axis_index(table: DataFrame, column: str, out: str) -> DataFrame:
    """Distinct values of a column with their position 0, 1, ... in sorted order.

    A short axis is numbered on the driver and broadcast, a long one is ranked by Spark.
    """
    axis = table.select(column).where(F.col(column).isNotNull()).distinct()
    rows = axis.limit(BROADCAST_ROWS + 1).toArrow()
    if rows.num_rows > BROADCAST_ROWS:
        return ranked(axis, [], [column], out).select(column, (F.col(out) - 1).alias(out))
    rows = rows.sort_by(column)
    rows = rows.append_column(out, pa.array(range(rows.num_rows), pa.int64()))
    schema = T.StructType(axis.schema.fields + [T.StructField(out, T.LongType())])
    return F.broadcast(table.sparkSession.createDataFrame(rows, schema=schema))


def exact_quantiles(
    table: DataFrame,
    columns: Sequence[str],
    parts: int,
    numerators: Sequence[int] | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Exact linearly interpolated quantiles ``k / parts`` of columns: (by, feature, k, quantile).

    Wanted quantiles (``numerators``) are bracketed by a sketch, and only the rows inside the
    brackets are looked at; for all of them (None) all distinct values are ranked.  All
    position arithmetic is in integers.
    """
    by, d = list(by), int(parts)
    keys = [*by, "feature"]
    pairs = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("_x")) for c in columns])
    long = (table.select(*by, F.explode(pairs).alias("_p"))
            .select(*by, "_p.feature", "_p._x").where("_x IS NOT NULL"))
    if numerators is None:
        ends = _ends_by_ranks(long, keys, d)
    else:
        ends = _ends_by_brackets(long, keys, d, [int(k) for k in numerators])
    fraction = _fraction(d)
    between = F.when(fraction > 0, (F.col("_hi") - F.col("_lo")) * fraction).otherwise(0.0)
    return ends.select(*keys, F.col("k").cast("long").alias("k"), (F.col("_lo") + between).alias("quantile"))


def _fraction(d: int) -> Column:
    """How far quantile k lies from its lower to its upper rank."""
    return F.expr(f"cast((k * (_count - 1)) % {d} as double) / {d}")


def _grid() -> Column:
    """The evenly spaced shares, as one literal expression."""
    return F.expr(f"array({', '.join(f'{i / _GRID}D' for i in range(_GRID + 1))})")


def sketch_around(table: DataFrame, by: Sequence[str], column: str, shares: Sequence[float]) -> DataFrame:
    """Per group the row count ``_count`` and in ``_q`` two values around the quantile of each share.

    The rows of the share's rank and its neighbours lie between the two, both included; in a
    small group they are infinite, so that all its rows do.
    """
    grid = _grid()
    sketch = table.groupBy(*by).agg(
        F.percentile_approx(column, grid, F.lit(SKETCH_ACCURACY)).alias("_all"), F.count("*").alias("_count"))
    margin = F.lit(BRACKET) + 2.0 / F.col("_count")
    around = []
    for s in shares:
        below, above = F.floor((s - margin) * _GRID).cast("int"), F.ceil((s + margin) * _GRID).cast("int")
        around.append(F.when(below < 0, F.lit(-math.inf)).otherwise(F.get("_all", below)))
        around.append(F.when(above > _GRID, F.lit(math.inf)).otherwise(F.get("_all", above)))
    return small_side(sketch.select(*by, F.array(*around).alias("_q"), "_count"))


def bracket_at(table: DataFrame, wanted: DataFrame, by: Sequence[str], column: str, rank: Column) -> DataFrame:
    """``wanted`` with ``_from`` and ``_to``: values of ``column`` around the row of a rank in its group.

    As in ``sketch_around``, but for a rank of each row of ``wanted``; null where a bracket has no such end.
    """
    grid = _grid()
    sketch = table.groupBy(*by).agg(
        F.percentile_approx(column, grid, F.lit(SKETCH_ACCURACY)).alias("_all"), F.count(F.lit(1)).alias("_count"))
    share, margin = rank / F.col("_count"), F.lit(BRACKET) + 2.0 / F.col("_count")
    below, above = F.floor((share - margin) * _GRID).cast("int"), F.ceil((share + margin) * _GRID).cast("int")
    ends = join_on_keys(wanted, sketch, list(by), "inner").withColumns({
        "_from": F.when(below >= 0, F.get("_all", below)), "_to": F.when(above <= _GRID, F.get("_all", above))})
    return small_side(ends.drop("_all", "_count"))


def _ends_by_brackets(long: DataFrame, keys: list[str], d: int, numerators: list[int]) -> DataFrame:
    """Values at the two ranks around each quantile, from the rows between two sketched quantiles.

    Rows below a bracket are only counted, rows above it dropped, both before the shuffle.
    """
    known = sketch_around(long, keys, "_x", [k / d for k in numerators])
    brackets = F.array(*[
        F.struct(F.lit(k).cast("long").alias("k"), F.col("_q")[2 * i].alias("_from"), F.col("_q")[2 * i + 1].alias("_to"))
        for i, k in enumerate(numerators)])
    inside = (join_on_keys(long, known, keys, "inner").select(*keys, "_count", "_x", F.inline(brackets))
              .where("_x <= _to").withColumn("_x", F.when(F.col("_x") >= F.col("_from"), F.col("_x"))))
    counts = inside.groupBy(*keys, "k", "_count", "_x").agg(F.count("*").alias("_n"))
    # The rows below a bracket have become one NULL value, which sorts first.
    group = [*keys, "k"]
    spans = ranks_in(*rank_blocks(counts, group, ["_x"], "_n"), group, ["_x"])

    def at(rank: str) -> Column:
        return F.max(F.when(F.expr(f"_rank - _n <= {rank} AND {rank} < _rank"), F.col("_x")))

    lower = f"(k * (_count - 1)) div {d}"
    return spans.groupBy(*group, "_count").agg(at(lower).alias("_lo"), at(f"{lower} + 1").alias("_hi"))


def _ends_by_ranks(long: DataFrame, keys: list[str], d: int) -> DataFrame:
    """Values at the two ranks around each quantile, from the ranks of all distinct values.

    Equal values are counted before they are partitioned, so ties cost nothing, and only the
    blocks that hold a wanted rank are sorted.
    """
    counts = long.groupBy(*keys, "_x").agg(F.count("*").alias("_n"))
    rows, blocks = rank_blocks(counts, keys, ["_x"], "_n")

    # With 0-based ranks, quantile k lies between rank floor(k (n-1) / d) and the next one.
    # The k whose lower rank is in [start, end) run from first(start) to first(end) - 1.
    def first(start: str) -> str:
        return f"(({start}) * {d} + _total - 2) div (_total - 1)"

    def wanted(start: str, end: str) -> Column:
        ks = f"sequence({first(start)}, least({d}, {first(end)} - 1))"
        some = f"{first(start)} <= least({d}, {first(end)} - 1)"
        return F.expr(f"if(_total = 1, sequence(0L, {d}L), if({some}, {ks}, cast(array() as array<bigint>)))")

    before = "greatest(_before - 1, 0L)"
    needed = small_side(blocks.where(f"_total = 1 OR {first(before)} <= least({d}, {first('_before + _size')} - 1)"))
    spans = ranks_in(rows, needed, keys, ["_x"], some=True).withColumns({
        "_start": F.col("_rank") - F.col("_n"), "_end": F.col("_rank")})
    lower = wanted("_start", "_end")
    upper = F.when(F.expr("_total > 1 AND _end > 1"), wanted("greatest(_start - 1, 0L)", "_end - 1")).otherwise(
        F.expr("cast(array() as array<bigint>)"))
    hits = spans.select(*keys, "_total", "_x", F.explode(F.concat(
        F.transform(lower, lambda k: F.struct(k.alias("k"), F.lit(True).alias("low"))),
        F.transform(upper, lambda k: F.struct(k.alias("k"), F.lit(False).alias("low"))))).alias("_hit"))
    return hits.groupBy(*keys, "_hit.k", F.col("_total").alias("_count")).agg(
        F.max(F.when(F.col("_hit.low"), F.col("_x"))).alias("_lo"),
        F.max(F.when(~F.col("_hit.low"), F.col("_x"))).alias("_hi"))
