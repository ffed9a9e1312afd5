"""What several of the operators need: reading tables, names that cannot clash, column checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopanel.cluster import stored

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query of this subpackage and, where SQL can say it, its oracle."""
    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql.strip()
        return f
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each name, lengthened until no column of ``df`` has it (upper and lower case are alike)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def whole_text(name: str) -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(f"`{name}`"), F.lit(""))


def column(name: str) -> Column:
    return F.col(f"`{name}`")


def bounded_batches(spark: SparkSession) -> None:
    """Have whole texts travel to Python in batches of at most 8 MB, unless the session says otherwise."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


# A table of key slots has at most 2^18 rows of one int, however many keys fall into them.
SLOT_BITS = 18


def slot_of(hash64: Column) -> Column:
    """The slot of a 64-bit hash: one of 2^SLOT_BITS."""
    return F.shiftrightunsigned(hash64, 64 - SLOT_BITS).cast("int")


def in_slots(rows: DataFrame, hash64: Column, keys: DataFrame, key_hash64: Column, flag: str) -> DataFrame:
    """``rows`` with ``flag``: whether a row's key can be among ``keys``; no key is missed.

    The keys' slots are broadcast, a table of bounded size that is written first so that no
    broadcast waits for a long job; wide rows which no key concerns then need no shuffle.  The
    more keys there are, the more rows are flagged in vain; an exact join of the flagged rows
    follows.
    """
    slot, = fresh(rows, "_slot")
    slots = stored(keys.select(slot_of(key_hash64).alias(slot)).distinct(), "slots").withColumn(flag, F.lit(True))
    marked = rows.withColumn(slot, slot_of(hash64)).join(F.broadcast(slots), slot, "left").drop(slot)
    return marked.withColumn(flag, F.coalesce(flag, F.lit(False)))
