import datetime as dt

import pytest
from pyspark.sql import functions as F

from canopanel.operators import scaling, splits


@pytest.fixture(scope="module")
def samples(spark):
    rows = [(f"LHC{m:04d}", dt.date(y, 6, 1), float(m * y % 17), float(m)) for m in range(1, 11)
            for y in range(1996, 2004)]
    return spark.createDataFrame(rows, "member string, time date, x double, c double")


@pytest.fixture(scope="module")
def split(samples):
    members = splits.split_members(samples, 7, 3)
    return splits.split_member_time(samples, members, (2000, 2002))


def test_no_member_and_no_year_in_both(split):
    sides = {s: {(r["member"], r["time"].year) for r in split.where(F.col("split") == s).collect()}
             for s in ("train", "val")}
    for i in (0, 1):
        assert not {k[i] for k in sides["train"]} & {k[i] for k in sides["val"]}
    assert len(sides["train"]) == 7 * 5 and len(sides["val"]) == 3 * 3
    assert split.where("split IS NULL").count() == 80 - 35 - 9


def test_first_members_train(samples):
    got = {r["member"]: r["member_split"] for r in splits.split_members(samples, 7, 2).collect()}
    assert got["LHC0001"] == "train" and got["LHC0008"] == "val" and got["LHC0010"] is None


def test_member_counts_are_checked(samples):
    with pytest.raises(ValueError):
        splits.split_members(samples, 8, 3)
    with pytest.raises(ValueError):
        splits.split_members(samples, 7, 2, strict=True)


def test_split_inputs_are_checked(samples):
    with pytest.raises(ValueError, match="columns"):
        splits.check_split_inputs(samples, samples.drop("time"), 7, 3, (2000, 2002))
    with pytest.raises(ValueError, match="first <= last"):
        splits.check_split_inputs(samples, samples, 7, 3, (2002, 2000))
    with pytest.raises(ValueError, match="found"):
        splits.check_split_inputs(samples, samples, 70, 3, (2000, 2002))
    splits.check_split_inputs(samples, samples, 7, 3, (2000, 2002))


def test_masks_agree_for_labels_and_integers(samples, split):
    members = splits.split_members(samples, 7, 3)
    as_int = samples.withColumn("member", F.substring("member", 4, 4).cast("int"))
    for table in (samples, as_int):
        masks = splits.split_masks(table, members, (2000, 2002))
        assert masks.where("train_mask").count() == 35 and masks.where("val_mask").count() == 9
        assert masks.where("train_mask AND val_mask").count() == 0


def test_overlapping_periods_are_flagged(samples):
    got = splits.split_periods(samples, ("1901", "2000"), ("2000", "2014"))
    assert got.where("overlap").select(F.year("time")).distinct().collect()[0][0] == 2000


def test_validation_rows_do_not_move_the_scaler(split):
    train = F.col("split") == "train"
    changed = split.withColumn("x", F.when(train, F.col("x")).otherwise(1e6))
    a, b = (scaling.fit_standard(t.where(train), ["x", "c"]).first() for t in (split, changed))
    assert a == b


def test_standard_scale(split):
    moments = scaling.fit_standard(split, ["x"])
    out = scaling.standard_scale(split, moments, ["x"]).agg(F.avg("x"), F.stddev_pop("x")).first()
    assert out[0] == pytest.approx(0, abs=1e-12) and out[1] == pytest.approx(1)


def test_constant_column_is_centred(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [r[0] for r in scaling.standard_scale(df, scaling.fit_standard(df, ["x"]), ["x"]).collect()] == [0.0, 0.0]


def test_inverse_scale_undoes_scaling_per_slice(split):
    moments = scaling.fit_standard(split, ["x"], ["member"])
    scaled = scaling.standard_scale(split, moments, ["x"], ["member"])
    back = scaling.inverse_scale(scaled, moments, ["x"], ["member"], "_back").join(
        split.withColumnRenamed("x", "original"), ["member", "time"])
    assert back.agg(F.max(F.abs(F.col("x_back") - F.col("original")))).first()[0] < 1e-9


def test_quantile_references_map_to_even_steps(spark):
    df = spark.range(0, 1001).select(F.pow(F.col("id") / 1000, 3).alias("x"))
    table = scaling.fit_quantiles(df, ["x"], 101)
    at = table.select(F.col("quantile").alias("x"), F.col("ref"))
    out = scaling.quantile_scale(at, table, ["x"])
    assert out.agg(F.max(F.abs(F.col("x") - F.col("ref")))).first()[0] < 1e-12


def test_quantile_ties_get_the_middle_and_outside_is_clipped(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.0, 0.0, 1.0, 2.0, 2.0, 5.0)], "x double")
    table = scaling.fit_quantiles(df, ["x"], 7)
    probe = spark.createDataFrame([(v,) for v in (-9.0, 0.0, 0.5, 1.0, 2.0, 9.0)] + [(None,)], "x double")
    got = [r[0] for r in scaling.quantile_scale(probe, table, ["x"]).collect()]
    assert got[:-1] == pytest.approx([0, 0, 2.5 / 6, 3 / 6, 4.5 / 6, 1]) and got[-1] is None


def test_quantile_table_survives_storage(spark, tmp_path, samples):
    table = scaling.fit_quantiles(samples, ["x"], 11)
    table.write.parquet(str(tmp_path / "deep" / "quantiles"))
    stored = spark.read.parquet(str(tmp_path / "deep" / "quantiles"))
    a, b = (scaling.quantile_scale(samples, t, ["x"]).orderBy("member", "time").collect() for t in (table, stored))
    assert a == b


def test_saved_scalers(spark, tmp_path, samples):
    for name, fitted in (("quantiles", scaling.fit_quantiles(samples, ["x"], 7)), ("moments", scaling.fit_standard(samples, ["x"]))):
        scaling.save_scaler(fitted, str(tmp_path / name))
        read = scaling.load_scaler(spark, str(tmp_path / name))
        assert read.schema.simpleString() == fitted.schema.simpleString()
        assert sorted(map(tuple, read.collect())) == sorted(map(tuple, fitted.collect()))


def test_unknown_feature_in_quantiles(spark, samples):
    with pytest.raises(KeyError):
        scaling.quantile_scale(samples, scaling.fit_quantiles(samples, ["x"], 5), ["c"])
