"""Queries on sources, filters, reshaping and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopanel.cluster import shared_folder, small_values, stored
from canopanel.functions import calendar as cal
from canopanel.functions.labels import member_id
from canopanel.operators import aggregate, grids, region, reshape
from canopanel.operators.diagnostics import with_sigma
from canopanel.operators.region import CONUS, Box
from canopanel.plans import views as v
from canopanel.plans.registry import query, r, rounded
from canopanel.schema import to_float32
from canopanel.sources import tables as src

BAND = Box(CONUS.lon_min, CONUS.lon_max)
CELLS = range(25)


# ---- sources ------------------------------------------------------------------------

@query("src_open_select", """
    SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, CAST(l_shipdate AS DATE) AS time FROM lineitem""")
def src_open_select(spark: SparkSession, sf: str) -> DataFrame:
    opened = src.open_table(spark, f"{sf}/lineitem.parquet",
                            ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_shipdate"])
    return opened.withColumn("time", F.col("l_shipdate").cast("date")).drop("l_shipdate")


@query("src_multi_file", f"SELECT time, gridcell, {r('tsa')} AS tsa FROM forcing", "forcing")
def src_multi_file(spark, sf):
    folder = shared_folder(spark, "forcing")
    src.write_table(v.forcing(spark, sf).select("time", "gridcell", "tsa").repartition(4, "time"), folder)
    return rounded(src.open_table(spark, [f"{folder}/*.parquet"], ["time", "gridcell", "tsa"]))


@query("src_time_from_filename", f"SELECT time, gridcell, {r('tsa')} AS tsa FROM forcing", "forcing")
def src_time_from_filename(spark, sf):
    """Write one folder ``obs_YYYY`` per year and read the years back from the names.

    Steps that a year lacks are written as rows without a cell, as a file of a regular array
    would have them, and left out again after reading.
    """
    folder = shared_folder(spark, "yearly")
    steps = v.forcing(spark, sf).select(
        F.year("time").alias("year"), (F.month("time") - 1).alias("step"), "gridcell", "tsa")
    whole = steps.select("year").distinct().select("year", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("step"))
    filled = steps.unionByName(whole, allowMissingColumns=True)
    src.write_table(filled.withColumn("file", F.concat(F.lit("obs_"), "year")).drop("year"), folder, ["file"])
    read = src.read_yearly_files(spark, folder, filled.drop("year").schema)
    return rounded(read.where("gridcell IS NOT NULL")).select("time", "gridcell", "tsa")


@query("src_params", f"SELECT member, {r('p1')} AS p1, p2, p3 FROM params", "params")
def src_params(spark, sf):
    folder = shared_folder(spark, "params")
    src.write_csv(v.params(spark, sf).drop("member_label"), folder)
    return rounded(src.read_params_csv(spark, folder, ["p1", "p2", "p3"]))


# ---- projections and filters ----------------------------------------------------------

@query("proj_select", f"SELECT time, gridcell, {r('tsa')} AS tsa, {r('snow')} AS snow FROM forcing", "forcing")
def proj_select(spark, sf):
    return rounded(v.forcing(spark, sf).select("time", "gridcell", "tsa", "snow"))


@query("proj_cast", f"""
    SELECT member, time, gridcell, {r('CAST(CAST(value AS FLOAT) AS DOUBLE)', 4)} AS value FROM panel""", "panel")
def proj_cast(spark, sf):
    stored = to_float32(v.panel(spark, sf), ["value"])
    return rounded(stored.select("member", "time", "gridcell", F.col("value").cast("double").alias("value")), 4)


@query("forcing_precip", f"""
    SELECT time, gridcell, {r('tsa')} AS tsa, {r('rain + snow')} AS precip FROM forcing""", "forcing")
def forcing_precip(spark, sf):
    return rounded(with_precip(v.forcing(spark, sf)))


def with_precip(forcing: DataFrame) -> DataFrame:
    return forcing.withColumn("precip", F.col("rain") + F.col("snow")).drop("rain", "snow")


@query("filter_time_slice", """
    SELECT l_orderkey, l_linenumber, l_suppkey AS member, CAST(l_shipdate AS DATE) AS time FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1998-07-01'""")
def filter_time_slice(spark, sf):
    sliced = region.slice_time(v.table(spark, sf, "lineitem"), "1996", "1998-06", "l_shipdate")
    return sliced.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("member"),
                         F.col("l_shipdate").cast("date").alias("time"))


_BOX = "lon BETWEEN 235 AND 294 AND lat BETWEEN 24.5 AND 49.5"


@query("region_box_cells", f"SELECT gridcell FROM grid WHERE {_BOX}", "grid")
def region_box_cells(spark, sf):
    return region.box_cells(v.grid(spark, sf), CONUS)


@query("region_lon_band", "SELECT gridcell FROM grid WHERE lon BETWEEN 235 AND 294", "grid")
def region_lon_band(spark, sf):
    return region.box_cells(v.grid(spark, sf), BAND)


def conus_panel(spark: SparkSession, sf: str) -> DataFrame:
    return region.select_cells(v.panel(spark, sf), region.box_cells(v.grid(spark, sf), CONUS))


@query("region_semi_join", f"""
    SELECT member, time, gridcell, {r('value')} AS value FROM panel
    WHERE gridcell IN (SELECT gridcell FROM grid WHERE {_BOX})""", "panel grid")
def region_semi_join(spark, sf):
    return rounded(conus_panel(spark, sf).select("member", "time", "gridcell", "value"))


@query("region_flag", f"""
    SELECT gridcell IN (SELECT gridcell FROM grid WHERE {_BOX}) AS in_region, time, count(*) AS n,
           {r('avg(value)')} AS value FROM panel GROUP BY 1, 2""", "panel grid")
def region_flag(spark, sf):
    flagged = region.flag_cells(v.panel(spark, sf), region.box_cells(v.grid(spark, sf), CONUS))
    return rounded(flagged.groupBy("in_region", "time").agg(F.count("*").alias("n"), F.avg("value").alias("value")))


@query("grid_box_slice", f"""
    SELECT time, lat, lon, {r('lai')} AS lai FROM obs
    WHERE lat BETWEEN 2 AND 7 AND lon BETWEEN -80 AND 80""", "obs")
def grid_box_slice(spark, sf):
    return rounded(region.slice_box(v.obs(spark, sf), Box(-80, 80, 2, 7)))


@query("lon_normalise", f"""
    SELECT time, lat, (lon + 360) % 360 AS lon, {r('lai')} AS lai FROM obs""", "obs")
def lon_normalise(spark, sf):
    return rounded(region.normalise_longitude(v.obs(spark, sf)).orderBy("lon", "lat", "time"))


@query("filter_member_range", f"""
    SELECT member, time, gridcell, {r('value')} AS value FROM panel WHERE member BETWEEN 1 AND 499""", "panel")
def filter_member_range(spark, sf):
    return rounded(region.members_between(v.panel(spark, sf), 1, 499).select("member", "time", "gridcell", "value"))


@query("member_series", f"""
    SELECT time, gridcell, {r('value')} AS value FROM panel WHERE member = 1""", "panel")
def member_series(spark, sf):
    return rounded(region.member_series(v.panel(spark, sf), 1).select("time", "gridcell", "value"))


@query("distinct_members", "SELECT DISTINCT l_suppkey AS member FROM lineitem")
def distinct_members(spark, sf):
    return aggregate.distinct_values(v.pred(spark, sf), ["member"])


@query("drop_label", """
    SELECT * FROM (SELECT 'p1' AS name, min(p1) AS lo, max(p1) AS hi FROM params
                   UNION ALL SELECT 'p2', min(p2), max(p2) FROM params
                   UNION ALL SELECT 'p3', min(p3), max(p3) FROM params) WHERE name <> 'p3'""", "params")
def drop_label(spark, sf):
    return aggregate.column_bounds(v.params(spark, sf), ["p1", "p2", "p3"]).where("name <> 'p3'").drop("mean")


@query("uncertainty_sigma", f"""
    SELECT l_orderkey, l_linenumber, l_partkey, member, {r('sqrt(alea)')} AS alea_sigma,
           {r('sqrt(epis)')} AS epis_sigma FROM pred""", "pred")
def uncertainty_sigma(spark, sf):
    return rounded(with_sigma(v.pred(spark, sf)).select(*v.PRED_KEYS, "alea_sigma", "epis_sigma"))


_FIELDS = """
    SELECT a.lat, a.lon, {value} AS distance FROM
      (SELECT lat, lon, avg(lai) AS x FROM obs WHERE day(time) <= 15 GROUP BY 1, 2) a JOIN
      (SELECT lat, lon, avg(lai) AS y FROM obs WHERE day(time) > 15 GROUP BY 1, 2) b
      ON a.lat = b.lat AND a.lon = b.lon"""


@query("field_abs_distance", _FIELDS.format(value=r("abs(x - y)")), "obs")
def field_abs_distance(spark, sf):
    observed = v.obs(spark, sf)
    halves = [aggregate.mean_by(observed.where(c), ["lat", "lon"], ["lai"])
              for c in (F.dayofmonth("time") <= 15, F.dayofmonth("time") > 15)]
    return rounded(grids.field_distance(*halves, value="lai"))


# ---- calendar and labels ---------------------------------------------------------------

@query("time_parts", """
    SELECT l_orderkey, l_linenumber, l_partkey, member, CAST(year(time) AS INTEGER) AS year, month FROM pred""", "pred")
def time_parts(spark, sf):
    return reshape.with_time_features(v.pred(spark, sf), cyclic=False).select(*v.PRED_KEYS, "year", "month")


@query("cyclical_month", f"""
    SELECT DISTINCT time, {r('sin(2 * pi() * month(time) / 12)')} AS m_sin,
           {r('cos(2 * pi() * month(time) / 12)')} AS m_cos FROM pred""", "pred")
def cyclical_month(spark, sf):
    days = v.pred(spark, sf).select("time").distinct()
    return rounded(reshape.with_time_features(days).select("time", "m_sin", "m_cos"))


@query("calendar_to_date", """
    SELECT k, CASE WHEN d <= day(last_day(make_date(y, m, 1))) THEN make_date(y, m, d) END AS time
    FROM (SELECT o_orderkey AS k, 1901 + o_orderkey // 360 AS y, 1 + (o_orderkey // 30) % 12 AS m,
                 1 + o_orderkey % 30 AS d FROM orders)""")
def calendar_to_date(spark, sf):
    """Order numbers read as days of a 360-day calendar; 30 February has no date."""
    k = F.col("o_orderkey")
    day = cal.date_from_parts(F.floor(k / 360) + 1901, F.floor(k / 30) % 12 + 1, k % 30 + 1, strict=False)
    return v.table(spark, sf, "orders").select(k.alias("k"), day.alias("time"))


@query("month_name", """
    SELECT l_orderkey, l_linenumber, l_partkey, member, month, strftime(time, '%b') AS name, month AS back
    FROM pred""", "pred")
def month_name(spark, sf):
    named = v.pred(spark, sf).select(*v.PRED_KEYS, "month", cal.month_name(F.col("month")).alias("name"))
    return named.withColumn("back", cal.month_number(F.col("name")))


@query("member_id_normalise", """
    SELECT member_label, CAST(regexp_replace(member_label, '[^0-9]', '', 'g') AS BIGINT) AS member_id,
           count(*) AS n
    FROM params JOIN pred ON CAST(regexp_replace(member_label, '[^0-9]', '', 'g') AS BIGINT) = pred.member
    GROUP BY 1, 2""", "params pred")
def member_id_normalise(spark, sf):
    labelled = v.params(spark, sf).select("member_label", member_id(F.col("member_label")).alias("member_id"))
    counts = v.pred(spark, sf).groupBy(F.col("member").alias("member_id")).agg(F.count("*").alias("n"))
    return labelled.join(counts, "member_id").select("member_label", "member_id", "n")


# ---- reshaping ---------------------------------------------------------------------------

_STACK = """
    SELECT member, time, gridcell,
           (dense_rank() OVER (ORDER BY member) - 1) * t * g + (dense_rank() OVER (ORDER BY time) - 1) * g
             + dense_rank() OVER (ORDER BY gridcell) - 1 AS sample_id
    FROM panel, (SELECT count(DISTINCT time) AS t, count(DISTINCT gridcell) AS g FROM panel)"""


@query("stack_samples", _STACK, "panel")
def stack_samples(spark, sf):
    return reshape.stack_samples(v.stored_panel(spark, sf, ["member", "time", "gridcell"]))


@query("sample_slice", f"""
    SELECT gridcell, {r('value')} AS value FROM panel
    WHERE member = (SELECT min(member) FROM panel) AND time = (SELECT min(time) FROM panel)""", "panel")
def sample_slice(spark, sf):
    panel = v.stored_panel(spark, sf, ["member", "time", "gridcell", "value"])
    return rounded(reshape.sample_of(panel, 0, ("member", "time")).select("gridcell", "value"))


_WIDE = ", ".join(f"{r(f'max(value) FILTER (WHERE gridcell = {c})')} AS cell_{c}" for c in CELLS)


@query("stack_multitask", f"SELECT member, time, {_WIDE} FROM panel GROUP BY 1, 2", "panel")
def stack_multitask(spark, sf):
    cells = small_values(v.grid(spark, sf), "gridcell")
    return rounded(reshape.stack_multitask(v.panel(spark, sf), cells))


@query("unstack_tasks", f"SELECT member, time, gridcell, {r('value')} AS value FROM panel", "panel")
def unstack_tasks(spark, sf):
    cells = small_values(v.grid(spark, sf), "gridcell")
    wide = reshape.stack_multitask(v.panel(spark, sf), cells)
    return rounded(reshape.unstack_tasks(wide, ["member", "time"], cells))


@query("features_unpivot", "\nUNION ALL ".join(
    f"SELECT time, gridcell, '{f}' AS feature, {r(f)} AS value FROM forcing" for f in ("tsa", "rain", "snow")),
    "forcing")
def features_unpivot(spark, sf):
    return rounded(reshape.features_long(v.forcing(spark, sf), ["time", "gridcell"], ["tsa", "rain", "snow"]))


@query("panel_broadcast", f"""
    SELECT p.member, p.time, p.gridcell, {r('value')} AS value, {r('p1')} AS p1, p2, p3,
           {r('f.tsa')} AS tsa, {r('f.rain + f.snow')} AS precip
    FROM panel p JOIN params q ON p.member = q.member
         JOIN forcing f ON p.time = f.time AND p.gridcell = f.gridcell""", "panel params forcing")
def panel_broadcast(spark, sf):
    panel = v.stored_panel(spark, sf)
    values = panel.select("member", "time", "gridcell", "value")
    both = reshape.attach_params(values, v.params(spark, sf).drop("member_label"))
    return rounded(reshape.attach_forcing(both, with_precip(v.forcing_of(panel))))


@query("join_forcing", f"""
    SELECT p.member, p.time, p.gridcell, {r('p.value - f.tsa')} AS departure
    FROM panel p JOIN forcing f ON p.time = f.time AND p.gridcell = f.gridcell""", "panel forcing")
def join_forcing(spark, sf):
    """The panel lies bucketed by month and cell: neither its forcing nor the join moves it again."""
    panel = v.bucketed_panel(spark, sf, ["time", "gridcell"])
    joined = reshape.attach_forcing(panel.select("member", "time", "gridcell", "value"), v.forcing_of(panel))
    return rounded(joined.select("member", "time", "gridcell", (F.col("value") - F.col("tsa")).alias("departure")))


_MONTHS = "generate_series(DATE '1995-01-01', DATE '2001-11-01', INTERVAL 1 MONTH)"
_X = f"""
    SELECT member, {r('p1')} AS p1, p2, p3, time, CAST(year(time) AS INTEGER) AS year,
           CAST(month(time) AS INTEGER) AS month{{cyclic}}
    FROM params, (SELECT CAST(unnest({_MONTHS}) AS DATE) AS time)"""
_CYCLIC = f""", {r('sin(2 * pi() * month(time) / 12)')} AS m_sin, {r('cos(2 * pi() * month(time) / 12)')} AS m_cos"""


@query("x_input", _X.format(cyclic=_CYCLIC), "params")
def x_input(spark, sf):
    return rounded(reshape.x_input(v.params(spark, sf).drop("member_label"), "1995-01-01", "2001-11-01"))


@query("x_input_no_cyclic", _X.format(cyclic=""), "params")
def x_input_no_cyclic(spark, sf):
    return rounded(reshape.x_input(
        v.params(spark, sf).drop("member_label"), "1995-01-01", "2001-11-01", cyclic=False))


@query("concat_time", f"SELECT time, gridcell, {r('tsa')} AS tsa FROM forcing", "forcing")
def concat_time(spark, sf):
    periods = ("1901", "1997"), ("1998", "2014")
    return rounded(reshape.concat([v.forcing(spark, sf, p).select("time", "gridcell", "tsa") for p in periods]))


_SEASONS = {"djf": (12, 1, 2), "mam": (3, 4, 5), "jja": (6, 7, 8), "son": (9, 10, 11)}


def _season_frames(spark, sf) -> dict[str, DataFrame]:
    means = stored(aggregate.mean_by(
        cal_slices(v.pred(spark, sf)), ["member", "slice"], ["truth", "mu"]), "means")
    return {name: means.where(F.col("slice") == name.upper()).select(
        "member", F.col("truth").alias(f"{name}_truth"), F.col("mu").alias(f"{name}_mu")) for name in _SEASONS}


def cal_slices(pred: DataFrame) -> DataFrame:
    return pred.withColumn("slice", cal.season(F.col("month")))


@query("concat_wide", "\nUNION ALL ".join(
    "SELECT member, " + ", ".join(
        f"{r(f'avg({c})', 4) if n == name else 'CAST(NULL AS DOUBLE)'} AS {n}_{c}"
        for n in _SEASONS for c in ("truth", "mu"))
    + f" FROM pred WHERE month IN {months} GROUP BY 1" for name, months in _SEASONS.items()), "pred")
def concat_wide(spark, sf):
    return rounded(reshape.concat(list(_season_frames(spark, sf).values()), fill=True), 4)


@query("unify_slices", "\nUNION ALL ".join(
    f"SELECT member, {r('avg(truth)', 4)} AS truth, {r('avg(mu)', 4)} AS mu, '{name}' AS slice "
    f"FROM pred WHERE month IN {months} GROUP BY 1" for name, months in _SEASONS.items()), "pred")
def unify_slices(spark, sf):
    return rounded(reshape.unify_slices(_season_frames(spark, sf), ["truth", "mu"]), 4)


@query("attach_predictions", f"""
    SELECT l_orderkey, l_linenumber, l_partkey, member, {r('a.truth', 4)} AS truth, {r('b.mu', 4)} AS mu
    FROM pred a JOIN pred b USING (l_orderkey, l_linenumber, l_partkey, member)""", "pred")
def attach_predictions(spark, sf):
    p = v.pred(spark, sf)
    return rounded(reshape.attach_predictions(
        p.select(*v.PRED_KEYS, "truth"), p.select(*v.PRED_KEYS, "mu"), v.PRED_KEYS, how="inner"), 4)


@query("align_xy", f"""
    SELECT member, time, gridcell, {r('rain')} AS rain, {r('value')} AS value FROM panel""", "panel")
def align_xy(spark, sf):
    """Features and target lie bucketed by the sample's keys and meet without an exchange."""
    keys = ["member", "time", "gridcell"]
    p = v.bucketed_panel(spark, sf, keys)
    return rounded(reshape.align_xy(p.select(*keys, "rain"), p.select(*keys, "value"), keys))


@query("assemble_inputs", f"""
    SELECT member, b.tsa AS tsa, p2, b.precip AS precip, {r('p1')} AS p1, p3 FROM params,
      (SELECT {r('avg(tsa)')} AS tsa, {r('avg(rain + snow)')} AS precip FROM forcing) b""", "params forcing")
def assemble_inputs(spark, sf):
    held = with_precip(v.forcing(spark, sf)).agg(F.avg("tsa").alias("tsa"), F.avg("precip").alias("precip"))
    return rounded(reshape.assemble_inputs(
        v.params(spark, sf).drop("member_label"), held, ["tsa", "p2", "precip", "p1", "p3"]))


# ---- grids ---------------------------------------------------------------------------------

@query("nearest_axis", """
    WITH points AS (SELECT c_custkey AS k, 20.0::DOUBLE + c_custkey % 37 AS lat, 225.0::DOUBLE + c_custkey % 79 AS lon
                    FROM customer),
    a AS (SELECT DISTINCT lat AS la FROM cluster), o AS (SELECT DISTINCT lon AS lo FROM cluster),
    near_lat AS (SELECT k, arg_min(la, abs(la - lat) * 1000 - la / 1000) AS nearest_lat FROM points, a GROUP BY 1),
    near_lon AS (SELECT k, arg_min(lo, abs(lo - lon) * 1000 - lo / 1000) AS nearest_lon FROM points, o GROUP BY 1)
    SELECT k, nearest_lat, nearest_lon FROM near_lat JOIN near_lon USING (k)""", "cluster")
def nearest_axis(spark, sf):
    k = F.col("c_custkey")
    points = v.table(spark, sf, "customer").select(
        k.alias("k"), (20.0 + k % 37).alias("lat"), (225.0 + k % 79).alias("lon"))
    return grids.nearest_on_axes(points, v.cluster(spark, sf)).select("k", "nearest_lat", "nearest_lon")


@query("nearest_irregular", """
    SELECT k, arg_min(label, (abs(label - x), -label)) AS nearest
    FROM (SELECT c_custkey AS k, c_acctbal AS x FROM customer), (SELECT DISTINCT s_acctbal AS label FROM supplier) GROUP BY k""")
def nearest_irregular(spark, sf):
    """Each customer's balance on the irregular axis of all suppliers' balances."""
    labels = small_values(v.table(spark, sf, "supplier"), "s_acctbal")
    return v.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("k"), grids.nearest_label(F.col("c_acctbal"), labels).alias("nearest"))


_MANY_REGIONS = """many AS (
      SELECT c_custkey AS region, -180.0::DOUBLE + c_custkey * 7 % 360 AS lon_min,
             -180.0::DOUBLE + c_custkey * 7 % 360 + c_custkey % 41 * (CASE WHEN c_custkey % 500 = 0 THEN 12 ELSE 1 END) AS lon_max,
             c_custkey % 47 + 5.0::DOUBLE AS lat_min, c_custkey % 47 + 5.0::DOUBLE + c_custkey % 11 AS lat_max FROM customer)"""


@query("region_tiles", f"""
    WITH {_MANY_REGIONS},
    sides AS (SELECT *, lon_max - lon_min >= 360 AS whole, (lon_min + 720) % 360 AS west, (lon_max + 720) % 360 AS east FROM many)
    SELECT gridcell, region FROM grid JOIN sides ON lat BETWEEN lat_min AND lat_max
      AND (whole OR (west <= east AND lon BETWEEN west AND east) OR (west > east AND (lon >= west OR lon <= east)))""", "grid")
def region_tiles(spark, sf):
    """The cells of as many rectangles as there are customers, found by tiles."""
    k = F.col("c_custkey")
    west = -180.0 + k * 7 % 360
    south = k % 47 + 5.0
    many = v.table(spark, sf, "customer").select(
        k.alias("region"), west.alias("lon_min"), (west + k % 41 * F.when(k % 500 == 0, 12).otherwise(1)).alias("lon_max"),
        south.alias("lat_min"), (south + k % 11).alias("lat_max"))
    return region.assign_many_regions(v.grid(spark, sf), many).select("gridcell", "region")


_CLASSES = """
    near AS (
      SELECT gridcell,
        (SELECT arg_min(la, abs(la - g.lat) * 1000 - la / 1000) FROM (SELECT DISTINCT lat AS la FROM cluster)) AS la,
        (SELECT arg_min(lo, abs(lo - g.lon) * 1000 - lo / 1000) FROM (SELECT DISTINCT lon AS lo FROM cluster)) AS lo
      FROM grid g),
    classes AS (SELECT rcent AS cclass, max(gridcell) AS gridcell
                FROM near JOIN cluster ON la = lat AND lo = lon GROUP BY 1)"""


@query("regrid", f"""
    WITH {_CLASSES}, maps AS (SELECT gridcell, avg(value) AS value FROM panel GROUP BY 1)
    SELECT lat, lon, {r('value')} AS value FROM cluster LEFT JOIN classes USING (cclass)
    LEFT JOIN maps USING (gridcell)""", "panel grid cluster")
def regrid(spark, sf):
    means = aggregate.mean_by(v.panel(spark, sf), ["gridcell"], ["value"])
    return rounded(grids.regrid(means, v.grid(spark, sf), v.cluster(spark, sf)))


@query("regrid_crop", f"""
    WITH {_CLASSES}, maps AS (SELECT member, gridcell, avg(value) AS value FROM panel GROUP BY 1, 2)
    SELECT member, lat, lon, {r('value')} AS value
    FROM (SELECT DISTINCT member FROM maps) m CROSS JOIN
         (SELECT lat, lon, gridcell FROM cluster LEFT JOIN classes USING (cclass) WHERE {_BOX}) c
         LEFT JOIN maps USING (member, gridcell)""", "panel grid cluster")
def regrid_crop(spark, sf):
    means = aggregate.mean_by(v.panel(spark, sf), ["member", "gridcell"], ["value"])
    return rounded(grids.regrid(means, v.grid(spark, sf), v.cluster(spark, sf), dims=["member"], box=CONUS))


_RECTANGLES = ", ".join(
    f"('{name}', {b[0] % 360}, {b[1] % 360}, {b[2]}, {b[3]})" for name, b in region.NAMED_REGIONS.items())


@query("region_means", f"""
    WITH cells AS (
      SELECT region, gridcell, landarea FROM (VALUES {_RECTANGLES}) AS q(region, x0, x1, y0, y1)
      JOIN grid ON lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1 JOIN weights USING (gridcell)),
    areas AS (SELECT region, sum(landarea) AS area FROM cells GROUP BY 1)
    SELECT region, time, {r('sum(value * landarea) / any_value(area)')} AS value
    FROM cells JOIN panel USING (gridcell) JOIN areas USING (region) GROUP BY 1, 2""", "panel grid weights")
def region_means(spark, sf):
    cells = region.assign_regions(v.grid(spark, sf)).select("gridcell", "region")
    return rounded(aggregate.area_mean(
        v.panel(spark, sf).join(cells, "gridcell"), v.weights(spark, sf), ["region", "time"], selected=cells))
