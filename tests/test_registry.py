"""Every registered query against its oracle SQL, on the smallest given tables."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry_points  # noqa: E402
from tools.check_oracle import rows_of  # noqa: E402

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")

QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for file in SF.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    frame = QUERIES[name](spark, str(SF))
    columns, rows = rows_of(frame.columns, frame.collect())
    assert rows
    if name in ORACLES:
        result = con.execute(ORACLES[name])
        assert (columns, rows) == rows_of([d[0] for d in result.description], result.fetchall())


@pytest.mark.parametrize("name", [
    "anomaly_clim", "area_weighted_mean", "discard_test", "iqr_outliers", "panel_broadcast", "quantile_fit",
    "region_flag", "regrid_crop", "split_masks", "split_member_time", "stack_samples", "standard_scale_by_slice"])
def test_query_when_nothing_is_small(spark, con, monkeypatch, name):
    """The way taken by tables too large to broadcast gives the same rows."""
    monkeypatch.setattr("canopanel.cluster.BROADCAST_ROWS", 0)
    monkeypatch.setattr("canopanel.operators.ranking.BROADCAST_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        test_query(spark, con, name)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_workers_need_no_installed_package(tmp_path):
    """A job started elsewhere must run although the executors cannot import the library."""
    script = f"""
import os
import subprocess
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parent.parent)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as e
for name in ("score", "fit_history", "quantile_transform"):
    assert e.queries()[name](spark, {str(SF)!r}).count() > 0, name
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, check=True, timeout=600)
