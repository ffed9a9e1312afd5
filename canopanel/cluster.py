"""Helpers that keep plans safe on a cluster: checkpoints and size-checked broadcasts."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only after it was seen to have at most so many rows and bytes.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20


def _shared_root(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder


def set_shared_folder(spark: SparkSession) -> None:
    """Give a session without ``spark.checkpoint.dir`` one where driver and executors are one process.

    For entry points and tests; a session of several processes must come with its own setting.  The
    folder made here goes when the process ends.
    """
    if spark.conf.get("spark.checkpoint.dir", None) is None and re.match(r"local(\[|$)", spark.sparkContext.master):
        folder = tempfile.mkdtemp(prefix="canopanel-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table under the cluster's ``spark.checkpoint.dir``.

    All paths of one application share the folder ``canopanel-<application id>``, which can
    be deleted once the application has ended.
    """
    run = f"canopanel-{spark.sparkContext.applicationId}"
    return f"{_shared_root(spark).rstrip('/')}/{run}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder: lineage is cut, partitions and their order stay."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(_shared_root(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    For a table used several times: its plan runs once, and each later use scans only the
    columns it needs.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: list[str], buckets: int, sort: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table of ``buckets`` files by the hash of ``keys``, in the shared folder.

    For a table that is joined or grouped by ``keys`` many times: none of that moves its rows again.
    The table is an external one of a name of its own; its files lie where ``stored`` has its.
    """
    spark = df.sparkSession
    name = f"canopanel_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*(sort or keys))
    writer.option("path", shared_folder(spark, "bucketed")).saveAsTable(name)
    return spark.table(name)


def small_side(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """``df`` as a broadcast side if it has few rows and bytes, else ``df`` as it is.

    ``max_rows`` is ``BROADCAST_ROWS`` unless given.
    At most ``max_rows + 1`` rows reach the driver.  A small table is then computed once,
    however often the plan uses it; a large one is left to Spark's own choice of join.
    """
    max_rows = BROADCAST_ROWS if max_rows is None else max_rows
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows or rows.nbytes > BROADCAST_BYTES:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema=df.schema))


def small_values(df: DataFrame, column: str, max_rows: int = 1_000_000) -> list:
    """The sorted distinct values of one axis column (latitudes, months, features).

    An axis longer than ``max_rows`` raises: such a column is not an axis.
    """
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{column} has over {max_rows} distinct values; it is not an axis")
    return sorted(r[0] for r in rows)


def join_on_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join that also matches NULL keys; the right side's key columns are dropped."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on: Column | None = None
    for k in keys:
        match = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        on = match if on is None else on & match
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])
