"""Places of rows in the order of their group, without a window over a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopanel.cluster import join_on_keys, stored
from canopanel.llm.common import column, fresh


def positions(rows: DataFrame, group: str, order: list[str], pos_col: str, size_col: str, name: str) -> DataFrame:
    """``rows``, stored, with each row's place in its group (from 0) and the group's number of rows.

    Rows ascend by ``order``, nulls first.  The table is dealt by ranges of group and order, so a
    group of a third of all rows lies in many partitions; a table of one row per (partition, group)
    holds how many of a group's rows the partitions before hold.  Rows alike in group and order are
    dealt out by a running number; their places among each other are arbitrary.
    """
    uid, part, row, first, n = fresh(rows, "_uid", "_part", "_row", "_first", "_n")
    keys = [column(c).asc_nulls_first() for c in (group, *order)] + [F.col(uid)]
    numbered = stored(rows.withColumn(uid, F.monotonically_increasing_id()), f"{name}-rows")
    dealt = numbered.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(uid)
    dealt = stored(
        dealt.withColumn(part, F.spark_partition_id())
        .withColumn(row, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), f"{name}-dealt")
    share = dealt.groupBy(group, part).agg(F.min(row).alias(first), F.count(F.lit(1)).alias(n))
    whole = Window.partitionBy(group)
    before = whole.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    share = share.select(
        group, part, (F.coalesce(F.sum(n).over(before), F.lit(0)) - F.col(first)).alias(first),
        F.sum(n).over(whole).alias(size_col))
    return join_on_keys(dealt, share, [group, part], "inner").withColumn(pos_col, F.col(row) + F.col(first)).drop(part, row, first)
