import datetime as dt
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from canopanel.functions import calendar as cal
from canopanel.functions.labels import longitude_360, member_id
from canopanel.functions.special import lgamma, normal_cdf
from canopanel.schema import nan_to_null, require_columns


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


def test_member_id_takes_digits(spark):
    df = spark.createDataFrame([("LHC0001",), ("LHC0500",), ("7",), (None,)], "m string")
    assert [r[0] for r in df.select(member_id(F.col("m"))).collect()] == [1, 500, 7, None]


def test_member_id_without_digits_raises(spark):
    df = spark.createDataFrame([("abc",)], "m string")
    with pytest.raises(PySparkException, match="no digits"):
        df.select(member_id(F.col("m"))).collect()


def test_longitude(spark):
    df = spark.createDataFrame([(-125.0,), (0.0,), (360.0,), (359.5,), (-0.5,)], "x double")
    assert [r[0] for r in df.select(longitude_360(F.col("x"))).collect()] == [235.0, 0.0, 0.0, 359.5, 359.5]


def test_seasons(spark):
    df = spark.range(1, 13).select(cal.season(F.col("id")).alias("s"))
    assert [r[0] for r in df.collect()] == ["DJF"] * 2 + ["MAM"] * 3 + ["JJA"] * 3 + ["SON"] * 3 + ["DJF"]


def test_season_year_moves_december(spark):
    assert one(spark, cal.season_year(F.col("t")), t=dt.date(1999, 12, 5)) == 2000
    assert one(spark, cal.season_year(F.col("t")), t=dt.date(1999, 11, 5)) == 1999


def test_month_names_round_trip(spark):
    df = spark.range(1, 13).select("id", cal.month_name(F.col("id")).alias("n"))
    rows = df.select("id", "n", cal.month_number(F.col("n")).alias("b")).collect()
    assert all(r["id"] == r["b"] for r in rows)
    assert rows[0]["n"] == "Jan" and rows[11]["n"] == "Dec"
    assert one(spark, cal.month_number(F.col("n")), n="nothing") is None


def test_cyclical_month_lies_on_the_circle(spark):
    df = spark.range(1, 13).select(cal.month_sin(F.col("id")).alias("s"), cal.month_cos(F.col("id")).alias("c"))
    for r in df.collect():
        assert r["s"] ** 2 + r["c"] ** 2 == pytest.approx(1)


def test_date_from_parts(spark):
    parts = spark.createDataFrame([(2000, 2, 30), (2000, 2, 29)], "y int, m int, d int")
    column = cal.date_from_parts(F.col("y"), F.col("m"), F.col("d"), strict=False)
    assert [r[0] for r in parts.select(column).collect()] == [None, dt.date(2000, 2, 29)]
    with pytest.raises(PySparkException):
        parts.select(cal.date_from_parts(F.col("y"), F.col("m"), F.col("d"))).collect()


@pytest.mark.parametrize("start, end, expected", [
    ("1901", "2014", (dt.date(1901, 1, 1), dt.date(2015, 1, 1))),
    ("2000-02", "2000-12", (dt.date(2000, 2, 1), dt.date(2001, 1, 1))),
    ("2000-01-01", "2014-12-31", (dt.date(2000, 1, 1), dt.date(2015, 1, 1))),
])
def test_period_bounds(start, end, expected):
    assert cal.period_bounds(start, end) == expected


def test_period_includes_noon_of_the_last_day(spark):
    df = spark.createDataFrame([(dt.datetime(2014, 12, 31, 12),), (dt.datetime(2015, 1, 1),)], "t timestamp")
    assert df.where(cal.in_period(F.col("t"), "2000-01-01", "2014-12-31")).count() == 1


def test_lgamma(spark):
    xs = [0.01, 0.5, 1.0, 1.5, 2.0, 3.7, 10.0, 250.0, 1e6]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", lgamma(F.col("x")).alias("y"))
    for r in df.collect():
        assert r["y"] == pytest.approx(math.lgamma(r["x"]), rel=1e-12, abs=1e-12)


def test_normal_cdf(spark):
    df = spark.createDataFrame([(0.0,), (1.96,), (-40.0,), (None,)], "z double").select(normal_cdf("z"))
    values = [r[0] for r in df.collect()]
    assert values[:3] == pytest.approx([0.5, 0.9750021, 0.0], abs=1e-7) and values[3] is None


def test_require_columns(spark):
    with pytest.raises(KeyError, match="lat"):
        require_columns(spark.range(1), ["id", "lat"])


def test_nan_becomes_null_before_means(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (math.nan,)], "x double")
    assert nan_to_null(df).agg(F.avg("x")).first()[0] == 1.5
