"""Ways that do not grow with an axis, a number of regions or what was read before."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from canopanel.cluster import bucketed
from canopanel.operators import diagnostics, grids, moments, region, reshape, scaling


@pytest.fixture
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, -1)
    yield
    spark.conf.set(name, before)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nearest_label_of_a_long_irregular_axis(spark):
    rng = np.random.default_rng(1)
    axis = np.unique(np.round(rng.gamma(1.0, 100.0, 10_500), 3))[:10_000]
    x = np.concatenate([rng.uniform(-50, axis[-1] + 50, 500), axis[:50], (axis[10:40] + axis[11:41]) / 2, [axis[0], axis[-1]]])
    rows = spark.createDataFrame(pd.DataFrame({"x": x})).unionByName(spark.createDataFrame([(None,)], "x double"))
    got = {r["x"]: r["near"] for r in rows.select("x", grids.nearest_label(F.col("x"), axis).alias("near")).collect()}
    assert got.pop(None) is None
    for value, near in got.items():
        distance = np.abs(axis - value)
        assert near == axis[distance == distance.min()].max()


@pytest.mark.parametrize("labels", [[5.0], [1.0, 7.0], [0.0, 1.0, 10.0]])
def test_nearest_label_of_short_axes(spark, labels):
    rows = spark.createDataFrame([(float(x),) for x in range(-3, 14)], "x double")
    for r in rows.select("x", grids.nearest_label(F.col("x"), labels).alias("near")).collect():
        assert r["near"] == min(labels, key=lambda v: (abs(v - r["x"]), -v))


def test_regrid_of_frames_without_broadcasts(spark, no_broadcast, monkeypatch):
    monkeypatch.setattr(grids, "POINTS_AT_ONCE", 7)
    cluster = spark.createDataFrame(
        [(float(a), float(o), float((a * 7 + o) % 4) if a + o != 5 else None, float((a * 7 + o) % 4) if (a, o) in {(0, 0), (0, 1), (0, 2), (0, 3)} else None)
         for a in range(5) for o in range(6)], "lat double, lon double, cclass double, rcent double")
    cells = spark.createDataFrame([(10 + k, 0.0, float(k)) for k in range(3)], "gridcell int, lat double, lon double")
    values = spark.createDataFrame([(m, 10 + k, float(100 * m + k)) for m in range(5) for k in range(3) if (m, k) != (2, 1)],
                                   "member long, gridcell int, value double")
    full = grids.regrid(values, cells, cluster, dims=["member"])
    got = {(r["member"], r["lat"], r["lon"]): r["value"] for r in full.collect()}
    assert len(got) == full.count() == 5 * 30
    for (m, a, o), value in got.items():
        k = None if a + o == 5 else (a * 7 + o) % 4
        want = None if k is None or k == 3 or (m, k) == (2, 1) else 100 * m + k
        assert value == want
    joins = [line for line in plan_of(full).splitlines() if "Join" in line]
    assert joins and not any("lat" in line for line in joins)


def test_many_regions_equal_the_literal_ones(spark):
    rng = np.random.default_rng(2)
    points = [(i, float(o), float(a)) for i, (o, a) in enumerate(zip(rng.uniform(-180, 360, 300), rng.uniform(-90, 90, 300)))]
    points += [(900, 235.0, 42.0), (901, -125.0, 50.0), (902, 0.0, -90.0), (903, 359.999, 90.0), (904, 360.0, 0.0)]
    cells = spark.createDataFrame(points, "gridcell int, lon double, lat double")
    regions = {name: tuple(float(x) for x in box) for name, box in region.NAMED_REGIONS.items()}
    regions |= {"ring": (-180.0, 180.0, -10.0, 10.0), "across": (350.0, 370.0, -90.0, 90.0), "point": (-125.0, -125.0, 50.0, 50.0)}
    table = spark.createDataFrame([(n, *box) for n, box in regions.items()], "region string, lon_min double, lon_max double, lat_min double, lat_max double")
    got = sorted((r["gridcell"], r["region"]) for r in region.assign_many_regions(cells, table).collect())
    want = sorted((r["gridcell"], r["region"]) for r in region.assign_regions(cells, regions).collect())
    assert got == want and len(got) > 20


def test_the_plan_of_thousands_of_regions_stays_small(spark):
    many = spark.range(5000).select(
        F.col("id").alias("region"), (F.col("id") * 7 % 360 - 180).cast("double").alias("lon_min"),
        (F.col("id") * 7 % 360 - 175).cast("double").alias("lon_max"), (F.col("id") % 80).cast("double").alias("lat_min"),
        (F.col("id") % 80 + 3).cast("double").alias("lat_max"))
    cells = spark.range(360).select(F.col("id").alias("gridcell"), F.col("id").cast("double").alias("lon"), (F.col("id") % 85).cast("double").alias("lat"))
    found = region.assign_many_regions(cells, many)
    small = region.assign_many_regions(cells, many.limit(3))
    assert abs(len(plan_of(found)) - len(plan_of(small))) < 2000
    want = sum(
        (0 <= (c - (i * 7 % 360 + 180) % 360) % 360 <= 5) and i % 80 <= c % 85 <= i % 80 + 3 for c in range(360) for i in range(5000))
    assert found.count() == want


def test_bucketed_tables_meet_without_an_exchange(spark, no_broadcast):
    rows = spark.range(2000).select(
        (F.col("id") % 10).alias("member"), (F.col("id") % 40).alias("time"), (F.col("id") / 400).cast("int").alias("gridcell"),
        F.rand(1).alias("value"), F.rand(2).alias("rain")).dropDuplicates(["member", "time", "gridcell"])
    keys = ["member", "time", "gridcell"]
    table = bucketed(rows, keys, 4)
    aligned = reshape.align_xy(table.select(*keys, "rain"), table.select(*keys, "value"), keys)
    assert "Exchange" not in plan_of(aligned) and aligned.count() == rows.count()
    panel = bucketed(rows, ["time", "gridcell"], 4)
    forcing = panel.groupBy("time", "gridcell").agg(F.avg("rain").alias("rain_mean"))
    joined = reshape.attach_forcing(panel, forcing)
    assert "Exchange" not in plan_of(joined) and joined.count() == rows.count()


def test_merged_moments_equal_one_pass(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"gridcell": rng.integers(0, 5, 900), "month": rng.integers(1, 13, 900), "part": rng.integers(0, 3, 900),
                          "value": 1e6 + rng.normal(size=900), "rain": np.where(rng.random(900) < 0.2, np.nan, rng.gamma(1, size=900))})
    frame = frame[~((frame["part"] == 0) & (frame["gridcell"] == 4))]  # a group that comes later
    rows = spark.createDataFrame(frame).withColumn("rain", F.nanvl("rain", F.lit(None)))
    parts = [rows.where(F.col("part") == p) for p in range(3)]
    keys = ["gridcell", "month"]
    saved = moments.merged([moments.moments(p, keys, ["value"]) for p in parts[:2]], keys)
    grown = moments.to_climatology(moments.update(saved, parts[2], keys, ["value"]), keys).orderBy(*keys).toPandas()
    want = rows.groupBy(*keys).agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).orderBy(*keys).toPandas()
    assert np.allclose(grown["clim_mean"], want["m"], rtol=1e-12) and np.allclose(grown["clim_std"], want["s"], rtol=1e-6, atol=1e-6)
    scaler = moments.to_scaler(moments.merged([moments.moments(p, [], ["value", "rain"]) for p in parts], []), ["value", "rain"])
    one = scaling.fit_standard(rows, ["value", "rain"]).first()
    assert [scaler.first()[c] for c in scaler.columns] == pytest.approx([one[c] for c in scaler.columns], rel=1e-6)
    assert moments.moments(rows.limit(0), keys, ["value"]).count() == 0


def test_kernel_density_by_bins_equals_the_sum(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.gamma(2, 3, 700), [80.0], rng.normal(5, 0.1, 50)])
    rows = spark.createDataFrame(pd.DataFrame({"x": x})).unionByName(spark.createDataFrame([(None,)], "x double"))
    h = x.std(ddof=1) * len(x) ** -0.2
    for r in diagnostics.kde(rows, "x", 60).collect():
        at = x.min() + (x.max() - x.min()) * r["i"] / 59
        want = np.exp(-0.5 * ((at - x) / h) ** 2).sum() / (len(x) * h * np.sqrt(2 * np.pi))
        assert r["x"] == pytest.approx(at) and r["density"] == pytest.approx(want, abs=5e-10 / (h * 2.5))
    flat = diagnostics.kde(spark.createDataFrame([(2.0,)] * 3, "x double"), "x", 5).collect()
    assert len(flat) == 5 and all(r["density"] is None for r in flat)


def test_discard_opens_ties_key_by_key(spark):
    """Few values, many ties, keys of several types: the same rows as a full sort keeps."""
    rng = np.random.default_rng(6)
    frame = pd.DataFrame({"name": [f"k{int(v):03d}" for v in rng.integers(0, 40, 3000)], "n": rng.permutation(3000),
                          "alea": rng.integers(0, 3, 3000).astype(float), "truth": rng.normal(size=3000), "mu": 0.0})
    got = {r["i"]: (r["kept"], r["rmse"]) for r in diagnostics.discard_test(spark.createDataFrame(frame), ["alea"], ["name", "n"]).collect()}
    ordered = frame.sort_values(["alea", "name", "n"])
    for i in range(11):
        kept = 3000 - i * 3000 // 20
        want = np.sqrt((ordered["truth"][:kept] ** 2).mean())
        assert got[i] == (kept, pytest.approx(want))
