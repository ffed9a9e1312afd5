"""Exact dedup: group by a 128-bit content hash, compare bytes inside groups, keep one row.

Two rows are copies when their texts are identical, byte by byte, without any normalisation.
Only rows whose hash occurs more than once have their texts compared: they are grouped by
(hash, text), so a group of a third of all rows is collapsed on the map side and two texts
that share a hash fall into two groups.  All else is joined without texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopanel.cluster import stored
from canopanel.llm.common import column, fresh, in_slots, whole_text

def content_hash(text: Column) -> Column:
    """MD5 as 16 bytes."""
    return F.unhex(F.md5(text))


def _digests(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    text = whole_text(text_col)
    return docs.select(column(id_col).alias("id"), text.alias("text"), digest(text).alias("h"))


def _narrow(docs: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    """(id, h, sha, copies): rows without their texts; copies counts rows that are alike in all."""
    rows = _digests(docs, id_col, text_col, digest).select("id", "h", F.sha2("text", 256).alias("sha"))
    return stored(rows.groupBy("id", "h", "sha").agg(F.count(F.lit(1)).alias("copies")), "exact-rows")


def _classes(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    """(h, sha, keep_id, n) of every text that occurs more than once."""
    shared = rows.groupBy("h").agg(F.sum("copies").alias("n")).where("n > 1").select("h")
    compared = (
        in_slots(_digests(docs, id_col, text_col, digest), F.xxhash64("h"), shared, F.xxhash64("h"), "met").where("met")
        .groupBy("h", "text").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep_id")).where("n > 1"))
    return stored(compared.select("h", F.sha2("text", 256).alias("sha"), "keep_id", "n"), "exact-classes")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per input row: the id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays; null ids are smallest.  Null texts count
    as empty.  Rows repeated with id and text are one group as well, and exactly one of them is
    kept.  An empty table gives no rows; other columns of ``docs`` are not read.
    """
    rows = _narrow(docs, id_col, text_col, digest)
    classes = _classes(docs, rows, id_col, text_col, digest)
    found = rows.join(classes, ["h", "sha"], "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    keep_id = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return found.select(
        F.col("id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"),
        (keep_id.eqNullSafe(F.col("id")) & (F.col("copy") == 1)).alias("kept"), F.col("sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; conventions as in exact_groups.

    Where the staying row itself is repeated (same id, same text), one of its rows stays.
    """
    rows = _narrow(docs, id_col, text_col, digest)
    classes = _classes(docs, rows, id_col, text_col, digest)
    h, sha, keep_id, n, met = fresh(docs, "_h", "_sha", "_keep", "_n", "_met")
    mine = classes.withColumnsRenamed({"h": h, "sha": sha, "keep_id": keep_id, "n": n})
    text = whole_text(text_col)
    # Documents whose text is met once pass without a shuffle.
    marked = in_slots(docs.withColumn(h, digest(text)), F.xxhash64(h), classes, F.xxhash64("h"), met)
    single = marked.where(~F.col(met))
    group = marked.where(met).withColumn(sha, F.sha2(text, 256)).join(mine, [h, sha], "left")
    group = group.where(F.col(n).isNull() | F.col(keep_id).eqNullSafe(column(id_col)))
    again = rows.where("copies > 1").select("id", "h", "sha")
    if not again.isEmpty():  # rare: rows that differ in no text and no id
        i, = fresh(group, "_i")
        again = again.withColumnsRenamed({"id": i, "h": h, "sha": sha})
        on = group[h].eqNullSafe(again[h]) & group[sha].eqNullSafe(again[sha]) & column(id_col).eqNullSafe(F.col(i))
        once = group.join(again, on, "left_anti")
        group = once.unionByName(group.join(again, on, "left_semi").dropDuplicates([h, sha]))
    wanted = [column(c) for c in docs.columns]
    return single.select(wanted).unionByName(group.select(wanted))
