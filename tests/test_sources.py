import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopanel import cluster
from canopanel.schema import OBSERVED
from canopanel.sources import tables as src


def yearly(folder, year, steps):
    frame = pd.DataFrame([(s, 10.0, 20.0, float(s)) for s in range(steps)], columns=["step", "lat", "lon", "lai"])
    frame.astype({"step": "int32", "lai": "float32"}).to_parquet(folder / f"obs_{year}.parquet")


def test_years_come_from_file_names(spark, tmp_path):
    for year in (2000, 2001, 2002):
        yearly(tmp_path, year, 12)
    obs = src.read_yearly_files(spark, str(tmp_path), OBSERVED)
    assert obs.count() == 36
    assert obs.agg(F.min("time"), F.max("time")).first()[:] == (dt.date(2000, 1, 1), dt.date(2002, 12, 1))


def test_a_short_year_raises(spark, tmp_path):
    yearly(tmp_path, 2000, 12)
    yearly(tmp_path, 2001, 11)
    with pytest.raises(ValueError, match="obs_2001"):
        src.read_yearly_files(spark, str(tmp_path), OBSERVED)


def test_a_file_without_year_raises(spark, tmp_path):
    yearly(tmp_path, 2000, 12)
    (tmp_path / "obs_2000.parquet").rename(tmp_path / "observed.parquet")
    with pytest.raises(ValueError):
        src.read_yearly_files(spark, str(tmp_path), OBSERVED)


def test_open_checks_columns(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    assert src.open_table(spark, str(tmp_path / "t"), ["id"]).count() == 3
    with pytest.raises(KeyError):
        src.open_table(spark, str(tmp_path / "t"), ["TLAI"])


def test_many_files_in_any_order(spark, tmp_path):
    paths = []
    for i in (2, 0, 1):
        paths.append(str(tmp_path / f"part{i}"))
        spark.range(i * 10, i * 10 + 10).write.parquet(paths[-1])
    assert sorted(r[0] for r in src.open_table(spark, paths).collect()) == list(range(30))


def test_params_csv_with_labels(spark, tmp_path):
    path = tmp_path / "params.csv"
    path.write_text("member,p1,p2\nLHC0001,0.5,1\nLHC0002,1.5,2\n")
    params = src.read_params_csv(spark, str(path), ["p1", "p2"], T.StringType())
    assert [tuple(r) for r in params.orderBy("member").collect()] == [("LHC0001", 0.5, 1.0), ("LHC0002", 1.5, 2.0)]


def test_split_is_written_by_partition(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "val"), (3, None)], "id int, split string")
    src.write_split(df, str(tmp_path / "s"))
    assert sorted(p.name for p in (tmp_path / "s").iterdir() if p.is_dir()) == ["split=train", "split=val"]
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("p1", 0.25, 0.5)], "name string, S1 double, ST double")
    src.write_csv(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True, schema=df.schema).collect() == df.collect()


def test_small_side_leaves_large_tables_alone(spark):
    df = spark.range(100)
    assert cluster.small_side(df, max_rows=99) is df
    assert cluster.small_side(df, max_rows=100).count() == 100


def test_shared_folder_follows_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert cluster.shared_folder(spark, "x").startswith(root)
    assert cluster.stored(spark.range(5)).count() == 5


def test_axis_longer_than_allowed_raises(spark):
    with pytest.raises(ValueError, match="not an axis"):
        cluster.small_values(spark.range(11), "id", max_rows=10)
