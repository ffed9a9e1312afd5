import datetime as dt

import pytest
from pyspark.sql import functions as F

from canopanel.operators import aggregate, anomaly, grids, region, reshape
from canopanel.operators.region import Box


def values(df, keys, column):
    return {tuple(r[k] for k in keys): r[column] for r in df.collect()}


def test_time_mean_skips_missing(tiny_panel, tiny_frame):
    got = values(aggregate.mean_by(tiny_panel, ["member", "gridcell"], ["value"]), ["member", "gridcell"], "value")
    want = tiny_frame.groupby(["member", "gridcell"])["value"].mean()
    assert got == pytest.approx(want.to_dict())


def test_climatology(tiny_panel, tiny_frame):
    got = values(aggregate.climatology(tiny_panel), ["gridcell", "month"], "clim_std")
    want = tiny_frame.groupby(["gridcell", "month"])["value"].std(ddof=0)
    assert got == pytest.approx(want.to_dict())


@pytest.fixture(scope="module")
def weights(spark):
    return spark.createDataFrame([(c, float(c + 1)) for c in range(6)], "gridcell int, landarea double")


def test_area_mean_keeps_the_weight_of_missing_values(spark, weights):
    panel = spark.createDataFrame([(0, 1.0), (1, None)], "gridcell int, value double").withColumn("member", F.lit(1))
    def mean(**options):
        return aggregate.area_mean(panel, weights, ["member"], **options).first()["value"]
    assert mean() == pytest.approx(1 / 3)
    assert mean(weights_where_present=True) == pytest.approx(1.0)
    assert mean(denominator="all", scale_factor=21.0) == pytest.approx(1.0)
    with pytest.raises(ValueError):
        mean(denominator="none")


def test_area_mean_counts_selected_cells_without_a_row(spark, weights):
    rows = [("null row", 0, 1.0), ("null row", 1, None), ("no row", 0, 1.0), ("both", 0, 1.0), ("both", 1, 1.0)]
    panel = spark.createDataFrame(rows, "member string, gridcell int, value double")
    def means(**options):
        return {r["member"]: r["value"] for r in aggregate.area_mean(panel, weights, ["member"], **options).collect()}
    assert means() == pytest.approx({"null row": 1 / 3, "no row": 1 / 3, "both": 1.0})
    assert means(denominator="rows") == pytest.approx({"null row": 1 / 3, "no row": 1.0, "both": 1.0})
    three = spark.range(3).selectExpr("cast(id as int) AS gridcell")
    assert means(selected=three)["no row"] == pytest.approx(1 / 6)


def test_attached_tables_neither_lose_nor_multiply_rows(spark):
    panel = spark.createDataFrame([(1, 0.5), (2, 0.7), (None, 0.9)], "member long, value double")
    params = spark.createDataFrame([(1, 10.0)], "member long, p1 double")
    twice = spark.createDataFrame([(1, 10.0), (1, 11.0)], "member long, p1 double")
    with pytest.raises(Exception, match="no parameters for 2|no parameters for NULL"):
        reshape.attach_params(panel, params).collect()
    with pytest.raises(Exception, match="several parameters for 1"):
        reshape.attach_params(panel.where("member = 1"), twice).select("member").collect()
    left = {r["member"]: r["p1"] for r in reshape.attach_params(panel, params, how="left").collect()}
    assert left == {1: 10.0, 2: None, None: None}
    assert reshape.attach_params(panel, params, how="inner").count() == 1
    with pytest.raises(Exception, match="several prediction for 1"):
        reshape.attach_predictions(params, twice.withColumnRenamed("p1", "mu"), ["member"]).collect()
    with pytest.raises(Exception, match="no forcing for 2"):
        reshape.attach_forcing(panel.where("member > 0"), params, ["member"]).collect()
    with pytest.raises(Exception, match="no target for sample 2"):
        reshape.align_xy(panel.where("member > 0"), params, ["member"]).collect()
    with pytest.raises(Exception, match="no features for sample 1"):
        reshape.align_xy(panel.where("member = 2"), params, ["member"]).collect()


def test_rows_without_a_label_keep_their_place(spark):
    panel = spark.createDataFrame([(1, "a"), (1, "b"), (None, "a")], "member long, gridcell string")
    stacked = reshape.stack_samples(panel, ("member", "gridcell")).select("member", "gridcell", "sample_id")
    assert sorted(map(tuple, stacked.collect()), key=str) == sorted([(1, "a", 0), (1, "b", 1), (None, "a", None)], key=str)


def test_regions_across_the_first_meridian(spark):
    cells = spark.createDataFrame([(355.0, 0.0), (5.0, 0.0), (-5.0, 0.0), (180.0, 0.0)], "lon double, lat double")
    found = region.assign_regions(cells, {"across": (-10, 10, -5, 5), "all": (-180, 180, -5, 5)})
    assert sorted((r["lon"], r["region"]) for r in found.collect()) == [
        (-5.0, "across"), (-5.0, "all"), (5.0, "across"), (5.0, "all"), (180.0, "all"), (355.0, "across"), (355.0, "all")]
    assert {r["lon"] for r in region.slice_box(cells, region.Box(350, 10)).collect()} == {355.0, 5.0, -5.0}


def test_equal_weights_give_the_plain_mean(spark, tiny_panel):
    equal = spark.createDataFrame([(c, 2.0) for c in range(4)], "gridcell int, landarea double")
    full = tiny_panel.where("value IS NOT NULL")
    weighted = values(aggregate.area_mean(full, equal, denominator="rows"), ["member", "time"], "value")
    assert weighted == pytest.approx(values(aggregate.mean_by(full, ["member", "time"], ["value"]), ["member", "time"], "value"))


def test_anomalies_sum_to_zero(tiny_panel):
    sums = anomaly.time_mean_anomaly(tiny_panel).groupBy("member", "gridcell").agg(F.sum("anomaly").alias("s"))
    assert all(abs(r["s"]) < 1e-9 for r in sums.collect())


def test_zscore_has_mean_zero_and_deviation_one(tiny_panel):
    z = anomaly.anomaly(tiny_panel, "zscore").groupBy("gridcell", F.month("time")).agg(
        F.avg("anomaly").alias("m"), F.stddev_pop("anomaly").alias("s"))
    for r in z.collect():
        assert abs(r["m"]) < 1e-9 and r["s"] == pytest.approx(1, abs=1e-6)


def test_climatology_anomaly_uses_the_baseline_only(tiny_panel, tiny_frame):
    got = anomaly.anomaly(tiny_panel, "clim", ("1999", "1999"), ("2000", "2000"))
    base = tiny_frame[[t.year == 1999 for t in tiny_frame["time"]]].groupby(["gridcell", "month"])["value"].mean()
    rows = got.where("value IS NOT NULL").collect()
    assert {r["time"].year for r in rows} == {2000}
    for r in rows:
        assert r["anomaly"] == pytest.approx(r["value"] - base[(r["gridcell"], r["time"].month)])


def test_unknown_anomaly_mode(tiny_panel):
    with pytest.raises(ValueError):
        anomaly.anomaly(tiny_panel, "median")


def test_peak_and_trough_first_on_tie(spark):
    means = spark.createDataFrame([(1, 5.0), (2, 9.0), (3, 9.0), (4, 1.0), (5, 1.0)], "month int, v double")
    assert aggregate.peak_trough(means, "month", ["v"]).first()[:] == (2, 4)


def test_strict_cell_selection(spark, tiny_panel):
    cells = spark.createDataFrame([(1,), (9,)], "gridcell int")
    assert region.select_cells(tiny_panel, cells).select("gridcell").distinct().count() == 1
    with pytest.raises(KeyError, match="9"):
        region.select_cells(tiny_panel, cells, strict=True)


def test_flagged_region_equals_selected(spark, tiny_panel):
    cells = spark.createDataFrame([(1,), (2,)], "gridcell int")
    flagged = region.flag_cells(tiny_panel, cells)
    assert flagged.count() == tiny_panel.count()
    assert flagged.where("in_region").count() == region.select_cells(tiny_panel, cells).count()


def test_box_bounds_are_inclusive(spark):
    grid = spark.createDataFrame([(0, 235.0, 24.5), (1, 294.0, 49.5), (2, 234.9, 30.0), (3, 250.0, 50.0)],
                                 "gridcell int, lon double, lat double")
    assert sorted(r[0] for r in region.box_cells(grid, region.CONUS).collect()) == [0, 1]
    assert sorted(r[0] for r in region.box_cells(grid, Box(235, 294)).collect()) == [0, 1, 3]


def test_overlapping_regions_give_several_rows(spark):
    cells = spark.createDataFrame([(0, 250.0, 47.0), (1, 10.0, 47.0)], "gridcell int, lon double, lat double")
    names = sorted(r["region"] for r in region.assign_regions(cells).collect())
    assert names == ["Great Basin", "Northern Rockies"]


def test_stack_numbers_a_dense_array(tiny_panel):
    got = reshape.stack_samples(tiny_panel.select("member", "time", "gridcell"))
    assert sorted(r["sample_id"] for r in got.collect()) == list(range(3 * 24 * 4))
    r = got.where("member = 1 AND gridcell = 2 AND time = date'1999-03-01'").first()
    assert r["sample_id"] == 1 * 96 + 2 * 4 + 2


def test_multitask_round_trip(tiny_panel):
    wide = reshape.stack_multitask(tiny_panel, range(4))
    assert wide.count() == 72 and wide.columns[2:] == [f"cell_{c}" for c in range(4)]
    back = reshape.unstack_tasks(wide, ["member", "time"], range(4))
    kept = tiny_panel.where("value IS NOT NULL")
    assert back.count() == kept.count() and back.exceptAll(kept).count() == 0
    assert reshape.unstack_tasks(wide, ["member", "time"], range(4), dense=True).count() == 288


def test_array_targets_become_rows(spark):
    df = spark.createDataFrame([(1, [10.0, 20.0])], "member int, y array<double>")
    rows = reshape.unstack_array(df, ["member"], "y", [7, 9]).collect()
    assert [tuple(r) for r in rows] == [(1, 7, 10.0), (1, 9, 20.0)]


def test_x_input_is_members_times_months(spark):
    params = spark.createDataFrame([(1, 0.1), (2, 0.2)], "member long, p1 double")
    x = reshape.x_input(params, "2000-01-01", "2001-12-01")
    assert x.count() == 48 and set(x.columns) == {"member", "p1", "time", "year", "month", "m_sin", "m_cos"}
    assert x.where("member = 2").agg(F.min("p1"), F.max("p1")).first()[:] == (0.2, 0.2)
    assert "m_sin" not in reshape.x_input(params, "2000-01-01", "2000-01-01", cyclic=False).columns


def test_densify_fills_with_null(spark):
    sparse = spark.createDataFrame([(1, dt.date(2000, 1, 1), 0, 5.0)], "member long, time date, gridcell int, value double")
    months = [dt.date(2000, 1, 1), dt.date(2000, 2, 1)]
    dense = reshape.densify(sparse, {"time": months, "gridcell": [0, 1]}, ["member", "time", "gridcell"])
    assert dense.count() == 4 and dense.where("value IS NULL").count() == 3


def test_align_reports_missing_samples(spark):
    x = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, x double")
    y = spark.createDataFrame([(1, 1.0)], "k int, y double")
    with pytest.raises(Exception, match="no target"):
        reshape.align_xy(x, y, ["k"]).collect()
    assert reshape.align_xy(x, y, ["k"], strict=False).count() == 1


def test_nearest_label_ties_go_up(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (-3.0,), (9.0,), (None,)], "x double")
    got = [r[0] for r in df.select(grids.nearest_label(F.col("x"), [0, 1, 2])).collect()]
    assert got == [1.0, 2.0, 0.0, 2.0, None]


@pytest.fixture(scope="module")
def cluster(spark):
    rows = [(float(i), float(j), (i * 3 + j) % 4 if (i, j) != (2, 2) else None) for i in range(3) for j in range(3)]
    return spark.createDataFrame([(a, b, c, c) for a, b, c in rows], "lat double, lon double, cclass int, rcent int")


def test_regrid_of_a_constant_is_constant(spark, cluster):
    cells = spark.createDataFrame([(c, 0.1 + c % 3, 0.2 + c // 3) for c in range(6)],
                                  "gridcell int, lon double, lat double")
    field = spark.createDataFrame([(c, 1.0) for c in range(6)], "gridcell int, value double")
    out = {(r["lat"], r["lon"]): r["value"] for r in grids.regrid(field, cells, cluster).collect()}
    assert len(out) == 9 and out.pop((2.0, 2.0)) is None and set(out.values()) == {1.0}


def test_regrid_last_cell_wins_and_keeps_dims(spark, cluster):
    # Cells 0 and 1 both sit at grid point (0, 0), class 0.
    cells = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.1, 0.1)], "gridcell int, lon double, lat double")
    field = spark.createDataFrame([(m, c, 10.0 * m + c) for m in (1, 2) for c in (0, 1)],
                                  "member int, gridcell int, value double")
    out = grids.regrid(field, cells, cluster, dims=["member"])
    assert out.count() == 18
    assert {(r["member"], r["value"]) for r in out.where("value IS NOT NULL").collect()} == {(1, 11.0), (2, 21.0)}
    cropped = grids.regrid(field, cells, cluster, dims=["member"], box=Box(0, 1, 0, 1))
    assert cropped.count() == 8


def test_field_distance(spark):
    a = spark.createDataFrame([(0.0, 0.0, 3.0)], "lat double, lon double, value double")
    assert grids.field_distance(a, a.withColumn("value", F.lit(5.0))).first()["distance"] == 2.0


def test_corner_of_time_slice(tiny_panel):
    assert region.slice_time(tiny_panel, "1999-12", "2000").select("time").distinct().count() == 13


def test_unify_slices(spark):
    jan = spark.createDataFrame([(1, 2.0)], "member int, jan_mu double")
    feb = spark.createDataFrame([(1, 3.0)], "member int, feb_mu double")
    rows = reshape.unify_slices({"jan": jan, "feb": feb}, ["mu"]).collect()
    assert sorted(tuple(r) for r in rows) == [(1, 2.0, "jan"), (1, 3.0, "feb")]
    wide = reshape.concat([jan, feb], fill=True)
    assert wide.columns == ["member", "jan_mu", "feb_mu"] and wide.where("feb_mu IS NULL").count() == 1


def test_feature_vector_keeps_the_order(spark):
    df = spark.createDataFrame([(1.0, 2)], "a double, b int")
    assert reshape.feature_vector(df, ["b", "a"]).first()["x"] == [2.0, 1.0]


def test_one_sample_by_its_id(spark, tiny_panel):
    stacked = reshape.stack_samples(tiny_panel, ("member", "time"))
    for sample in (0, 1, 24, 71):
        want = reshape.sample_slice(stacked, sample).select(tiny_panel.columns)
        got = reshape.sample_of(tiny_panel, sample, ("member", "time"))
        assert got.count() == 4 and got.exceptAll(want).count() == 0
    assert reshape.sample_of(tiny_panel, 72, ("member", "time")).count() == 0


def test_nearest_label_on_regular_and_irregular_axes(spark):
    xs = [-99.0, 0.0, 0.49, 0.5, 0.51, 3.5, 7.2, 99.0, None]
    for axis in ([0.0, 1.0, 2.0, 3.0, 4.0], [0.0, 1.0, 5.0, 5.1], [2.0], [0.0, 1.05, 1.95, 3.0]):
        got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(grids.nearest_label(F.col("x"), axis)).collect()]
        assert got == [None if x is None else min(axis, key=lambda a: (abs(a - x), -a)) for x in xs]
