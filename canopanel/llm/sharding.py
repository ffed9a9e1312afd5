"""Extendible hashing: shards are buckets of hash prefixes, split until each fits its byte limit.

Every row has a 64-bit hash.  The directory starts with one bucket of all rows; a bucket over
the limit splits on its next hash bit, the others stay as they are.  Sizes are summed for eight
more bits at a time, so a round is one aggregation over the rows that are still open, and a
directory of at most 256 entries per open bucket comes back to them by an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopanel.cluster import stored
from canopanel.llm.common import column, fresh, whole_text

# Hash bits that one round looks ahead.
ROUND_BITS = 8
_BITS = 64


def _prefix(bits: Column, n) -> Column:
    return F.substring(bits, F.lit(1), n if isinstance(n, Column) else F.lit(n))


def _bits(*of: Column) -> Column:
    """64 hash bits as a string of 0 and 1: the first 16 hex digits of an MD5."""
    digest = F.md5(F.concat_ws("|", *of))
    halves = [F.lpad(F.conv(F.substring(digest, at, 8), 16, 2), 32, "0") for at in (1, 9)]
    return F.concat(*halves)


def shard(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, bytes, shard, depth, shard_bytes, shard_docs.

    ``bytes`` is the UTF-8 length of the text (null: 0), ``shard`` the hash prefix of the bucket
    (empty for one bucket of all rows), ``depth`` its number of bits.  Every shard has at most
    ``limit`` bytes.  A text longer than the limit can fit no shard: it is a shard alone, called
    ``!`` and its 64 hash bits, of depth 64.  Rows repeated with id and text are hashed with their number among
    their like, so that they spread over shards too.  Null ids are allowed.  An empty table
    gives no rows; other columns are not read: ``sharded`` has the rows themselves.
    """
    return _buckets(docs, limit, id_col, text_col).drop("m", "copy").withColumnRenamed("id", id_col)


def sharded(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", shard_col: str = "shard") -> DataFrame:
    """``docs``, every row and column as it is, with the shard of each row as ``shard`` names it.

    A column of the same name stays, the new one then has a longer name.
    """
    i, m, k, name = fresh(docs, "_id", "_m", "_copy", shard_col)
    buckets = _buckets(docs, limit, id_col, text_col).select(
        F.col("id").alias(i), F.col("m").alias(f"{m}of"), F.col("copy").alias(f"{k}of"), F.col("shard").alias(name))
    like = Window.partitionBy(column(id_col), m).orderBy(m)
    rows = docs.withColumn(m, F.md5(whole_text(text_col))).withColumn(k, F.row_number().over(like))
    same = column(id_col).eqNullSafe(F.col(i)) & (F.col(m) == F.col(f"{m}of")) & (F.col(k) == F.col(f"{k}of"))
    return rows.join(buckets, same).select(*[column(c) for c in docs.columns], name)


def write_shards(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` as Parquet under a new ``path``, each shard one file in a folder of its own.

    The folders' column is ``shard``, or a longer name as in ``sharded``; its values are ``b``
    and the name of the shard, so that no reader takes bits for numbers.
    """
    rows = sharded(docs, limit, id_col, text_col)
    name = rows.columns[-1]
    rows.withColumn(name, F.concat(F.lit("b"), name)).repartition(name).write.partitionBy(name).parquet(path)


def _buckets(docs: DataFrame, limit: int, id_col: str, text_col: str) -> DataFrame:
    """What ``shard`` gives, with the MD5 of the text and the row's number among its like."""
    if limit < 1:
        raise ValueError("the limit is at least one byte")
    text = whole_text(text_col)
    # Equal rows meet once, counted on the map side; each of them gets a hash of its own.
    rows = (
        docs.select(column(id_col).alias("id"), F.md5(text).alias("m"), F.octet_length(text).cast("long").alias("bytes"))
        .groupBy("id", "m", "bytes").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))))
    rows = stored(rows.select("id", "m", "copy", "bytes", _bits(
        F.coalesce(F.col("id").cast("string"), F.lit("~")), F.col("m"), F.col("copy").cast("string")).alias("bits")), "shard-rows")
    alone = rows.where(F.col("bytes") > limit).select(
        "id", "m", "copy", "bytes", F.concat(F.lit("!"), "bits").alias("shard"), F.lit(_BITS).alias("depth"),
        F.col("bytes").alias("shard_bytes"), F.lit(1).cast("long").alias("shard_docs"))
    done, open_rows, depth = [alone], rows.where(F.col("bytes") <= limit), 0
    while True:
        deep = min(depth + ROUND_BITS, _BITS)
        directory = stored(_directory(open_rows, depth, deep, limit), "shard-directory")
        found = open_rows.withColumn("key", _prefix(F.col("bits"), deep)).join(directory, "key")
        done.append(found.where("depth is not null").select("id", "m", "copy", "bytes", "shard", "depth", "shard_bytes", "shard_docs"))
        if deep == _BITS or directory.where("depth is null").isEmpty():
            break
        open_rows, depth = stored(found.where("depth is null").select("id", "m", "copy", "bytes", "bits"), "shard-open"), deep
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _directory(rows: DataFrame, depth: int, deep: int, limit: int) -> DataFrame:
    """For each prefix of ``deep`` bits in use: the bucket of fewest bits, over ``depth``, that fits.

    ``depth`` is null where even ``deep`` bits do not, unless these are all bits.  A bucket of
    no bits at all is looked at in the first round only: later ones were found too large.
    """
    last = deep == _BITS
    fine = rows.groupBy(_prefix(F.col("bits"), deep).alias("key")).agg(
        F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n"))
    levels = fine.withColumn("depth", F.explode(F.sequence(F.lit(depth + 1 if depth else 0), F.lit(deep))))
    buckets = (
        levels.groupBy(_prefix(F.col("key"), F.col("depth")).alias("shard"), "depth")
        .agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
        .where((F.col("shard_bytes") <= limit) | (F.lit(last) & (F.col("depth") == deep))))
    fits = levels.select("key", "depth", _prefix(F.col("key"), F.col("depth")).alias("shard")).join(buckets, ["shard", "depth"])
    best = fits.groupBy("key").agg(F.min(F.struct("depth", "shard", "shard_bytes", "shard_docs")).alias("best"))
    return fine.select("key").join(best, "key", "left").select("key", "best.depth", "best.shard", "best.shard_bytes", "best.shard_docs")
