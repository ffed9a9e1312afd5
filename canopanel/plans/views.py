"""The study's views over the given tables, once for Spark and once as SQL text.

panel(member, time, gridcell, value, rain, snow), grid, weights, params, forcing, pred, nig,
obs and cluster.  Both forms describe the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopanel.cluster import bucketed, stored
from canopanel.functions.calendar import in_period
from canopanel.sources.tables import open_table

PRED_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "member"]

# Order of the event types on the observation grid's longitude axis.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


# Schemas of the given tables, so that opening one needs no look into its files.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return open_table(spark, f"{sf}/{name}.parquet", schema=T.StructType.fromDDL(SCHEMAS[name]))


def panel(spark: SparkSession, sf: str, period: tuple[str, str] | None = None) -> DataFrame:
    """The panel, or its part in a period of whole months, cut at the scan of the large table."""
    items = table(spark, sf, "lineitem")
    if period is not None:
        items = items.where(in_period(F.col("l_shipdate"), *period))
    items = items.select(
        "l_orderkey", F.col("l_suppkey").alias("member"),
        F.trunc(F.col("l_shipdate").cast("date"), "month").alias("time"),
        "l_quantity", "l_tax", "l_discount")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("gridcell"))
    # Orders find their cell first, so that the large lineitem table is shuffled for one join
    # only; the hint keeps Spark from broadcasting lineitem where its few columns look small.
    located = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "gridcell").hint("merge")
    joined = items.join(located, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("member", "time", "gridcell").agg(
        F.avg("l_quantity").alias("value"), F.avg("l_tax").alias("rain"), F.avg("l_discount").alias("snow"))


def grid(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf, "nation").select(
        n.alias("gridcell"), (225.0 + 3 * n).alias("lon"), (20.0 + 1.4 * ((n * 7) % 25)).alias("lat"))


def weights(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("gridcell")).agg(
        F.count("*").alias("landarea"))


def params(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("member"), F.col("s_name").alias("member_label"),
        F.col("s_acctbal").alias("p1"), F.col("s_nationkey").cast("double").alias("p2"),
        (F.col("s_suppkey") % 7).cast("double").alias("p3"))


def sens_params(spark: SparkSession, sf: str) -> DataFrame:
    """Six parameters per member, for sensitivity analysis."""
    key = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        key.alias("member"), F.col("s_acctbal").alias("p1"), F.col("s_nationkey").cast("double").alias("p2"),
        *[(key % n).cast("double").alias(f"p{i}") for i, n in ((3, 7), (4, 11), (5, 13), (6, 17))])


def stored_panel(spark: SparkSession, sf: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The panel, or some of its columns, written once for queries that read it several times."""
    whole = panel(spark, sf)
    return stored(whole if columns is None else whole.select(*columns), "panel")


def bucketed_panel(spark: SparkSession, sf: str, keys: Sequence[str]) -> DataFrame:
    """The panel, written once, in buckets of ``keys``: as many as the session has shuffle partitions."""
    return bucketed(panel(spark, sf), list(keys), int(spark.conf.get("spark.sql.shuffle.partitions")))


def forcing(spark: SparkSession, sf: str, period: tuple[str, str] | None = None) -> DataFrame:
    return forcing_of(panel(spark, sf, period))


def forcing_of(panel: DataFrame) -> DataFrame:
    return panel.groupBy("time", "gridcell").agg(
        F.avg("value").alias("tsa"), F.avg("rain").alias("rain"), F.avg("snow").alias("snow"))


def pred(spark: SparkSession, sf: str) -> DataFrame:
    day = F.col("l_shipdate").cast("date")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("member"),
        day.alias("time"), F.month(day).alias("month"), F.col("l_extendedprice").alias("truth"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("mu"),
        F.col("l_tax").alias("alea"), F.col("l_discount").alias("epis"))


def nig(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("member"),
        F.col("l_quantity").alias("gamma"), (1 + F.col("l_tax")).alias("nu"),
        (2 + F.col("l_discount")).alias("alpha"), (0.5 + F.col("l_tax")).alias("beta"),
        (F.col("l_quantity") * 1.05).alias("y"))


def obs(spark: SparkSession, sf: str) -> DataFrame:
    """Observed field: latitude user_id % 10, longitude by event type (-180 .. 180)."""
    types = F.array(*[F.lit(e) for e in EVENT_TYPES])
    lon = (F.nullif(F.array_position(types, F.col("event_type")), F.lit(0)) - 1) * 80.0 - 160.0
    return table(spark, sf, "events").groupBy(
        F.col("ts").cast("date").alias("time"), (F.col("user_id") % 10).cast("double").alias("lat"),
        lon.alias("lon")).agg(F.avg("value").alias("lai"))


def cluster(spark: SparkSession, sf: str) -> DataFrame:
    """A 20 x 20 lat/lon grid over the given cells: class (i*20 + j) % 30, 25 of them in use."""
    cells = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c"))
    points = cells.select(F.explode(F.sequence(F.col("c") * 16, F.col("c") * 16 + 15)).alias("k"))
    i, j = F.floor(F.col("k") / 20), F.col("k") % 20
    cclass = (F.col("k") % 30).cast("int")
    return points.select((20.0 + 1.75 * i).alias("lat"), (225.0 + 4.0 * j).alias("lon"),
                         cclass.alias("cclass"), cclass.alias("rcent"))


# The same views as SQL, each with the views it needs.
_VIEWS = {
    "panel": ((), """
        SELECT l_suppkey AS member, CAST(date_trunc('month', l_shipdate) AS DATE) AS time,
               c_nationkey AS gridcell, avg(l_quantity) AS value, avg(l_tax) AS rain, avg(l_discount) AS snow
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        GROUP BY 1, 2, 3"""),
    "grid": ((), """
        SELECT n_nationkey AS gridcell, 225.0::DOUBLE + 3 * n_nationkey AS lon,
               20.0::DOUBLE + 1.4::DOUBLE * ((n_nationkey * 7) % 25) AS lat FROM nation"""),
    "weights": ((), "SELECT c_nationkey AS gridcell, count(*) AS landarea FROM customer GROUP BY 1"),
    "params": ((), """
        SELECT s_suppkey AS member, s_name AS member_label, s_acctbal AS p1,
               CAST(s_nationkey AS DOUBLE) AS p2, CAST(s_suppkey % 7 AS DOUBLE) AS p3 FROM supplier"""),
    "sens_params": ((), """
        SELECT s_suppkey AS member, s_acctbal AS p1, CAST(s_nationkey AS DOUBLE) AS p2,
               CAST(s_suppkey % 7 AS DOUBLE) AS p3, CAST(s_suppkey % 11 AS DOUBLE) AS p4,
               CAST(s_suppkey % 13 AS DOUBLE) AS p5, CAST(s_suppkey % 17 AS DOUBLE) AS p6 FROM supplier"""),
    "forcing": (("panel",), """
        SELECT time, gridcell, avg(value) AS tsa, avg(rain) AS rain, avg(snow) AS snow FROM panel GROUP BY 1, 2"""),
    "pred": ((), """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS member, CAST(l_shipdate AS DATE) AS time,
               CAST(month(l_shipdate) AS INTEGER) AS month, l_extendedprice AS truth,
               l_extendedprice * (1 - l_discount) AS mu, l_tax AS alea, l_discount AS epis FROM lineitem"""),
    "nig": ((), """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS member, l_quantity AS gamma, 1 + l_tax AS nu,
               2 + l_discount AS alpha, 0.5::DOUBLE + l_tax AS beta, l_quantity * 1.05::DOUBLE AS y FROM lineitem"""),
    "obs": ((), """
        SELECT CAST(ts AS DATE) AS time, CAST(user_id % 10 AS DOUBLE) AS lat,
               CASE event_type WHEN 'click' THEN -160.0 WHEN 'error' THEN -80.0 WHEN 'purchase' THEN 0.0
                    WHEN 'signup' THEN 80.0 WHEN 'view' THEN 160.0 END::DOUBLE AS lon, avg(value) AS lai
        FROM events GROUP BY 1, 2, 3"""),
    "cluster": ((), """
        SELECT 20.0::DOUBLE + 1.75::DOUBLE * (k // 20) AS lat, 225.0::DOUBLE + 4.0::DOUBLE * (k % 20) AS lon,
               CAST(k % 30 AS INTEGER) AS cclass, CAST(k % 30 AS INTEGER) AS rcent
        FROM (SELECT n_nationkey * 16 + o.r AS k FROM nation, range(16) AS o(r))"""),
}


def with_views(names: str, body: str) -> str:
    """``body`` preceded by the views it names (space-separated) and those they need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in _VIEWS[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for n in names.split():
        add(n)
    views = ",\n".join(f"{n} AS ({_VIEWS[n][1].strip()})" for n in ordered)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"
