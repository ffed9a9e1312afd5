import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from canopanel.operators.ranking import axis_index, exact_quantiles, ranked, running_total


@pytest.fixture(scope="module")
def skewed(spark):
    """6,000 rows; one group holds two thirds of them and one value a third."""
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"g": np.where(rng.random(6000) < 2 / 3, "hot", rng.choice(list("abc"), 6000)),
                          "x": np.where(rng.random(6000) < 1 / 3, 5.0, rng.normal(5, 2, 6000)),
                          "k": rng.permutation(6000)})
    return frame, spark.createDataFrame(frame).repartition(7)


def test_ranks_equal_a_global_sort(skewed):
    frame, df = skewed
    got = ranked(df, ["g"], ["x", "k"]).toPandas().set_index("k")
    ordered = frame.sort_values(["x", "k"])
    want = (ordered.groupby("g").cumcount() + 1).set_axis(ordered["k"])
    assert (got["rank"].sort_index() == want.sort_index()).all()
    assert (got["total"] == frame.groupby("g")["k"].transform("size").set_axis(frame["k"]).reindex(got.index)).all()


def test_a_hot_group_is_spread_over_partitions(spark, skewed, monkeypatch):
    from canopanel import cluster
    from canopanel.operators import ranking
    written = []
    monkeypatch.setattr(ranking, "stored", lambda t, name: written.append(cluster.stored(t, name)) or written[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked(skewed[1], ["g"], ["x", "k"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert written[0].where("g = 'hot'").select("_part").distinct().count() > 1


def test_running_total_without_groups_and_with_null_group(spark):
    df = spark.createDataFrame([(None, 1, 2), (None, 2, 3), ("a", 1, 10)], "g string, x int, w int")
    got = {(r["g"], r["x"]): (r["running"], r["total"]) for r in running_total(df, ["g"], ["x"], "w").collect()}
    assert got == {(None, 1): (2, 5), (None, 2): (5, 5), ("a", 1): (10, 10)}
    rows = running_total(spark.range(100).withColumn("w", F.lit(2)), [], ["id"], "w").orderBy("id").collect()
    assert [r["running"] for r in rows] == [2 * (i + 1) for i in range(100)]


@pytest.mark.parametrize("parts", [1, 4, 10, 99, 1000])
def test_quantiles_equal_numpy(skewed, parts):
    frame, df = skewed
    got = exact_quantiles(df, ["x"], parts).orderBy("k").toPandas()
    assert list(got["k"]) == list(range(parts + 1))
    assert np.allclose(got["quantile"], np.quantile(frame["x"], np.arange(parts + 1) / parts), rtol=1e-12)


@pytest.mark.parametrize("bracket", [1e-3, 0.05, 0.6])
def test_bracketed_quantiles_equal_numpy(skewed, monkeypatch, bracket):
    from canopanel.operators import ranking
    monkeypatch.setattr(ranking, "BRACKET", bracket)
    frame, df = skewed
    got = exact_quantiles(df, ["x"], 100, [0, 1, 25, 50, 75, 99, 100], by=["g"]).toPandas()
    assert len(got) == 4 * 7
    for (g, k), part in got.groupby(["g", "k"]):
        assert np.isclose(part["quantile"].iloc[0], np.quantile(frame["x"][frame["g"] == g], k / 100), rtol=1e-12)


def test_quantiles_per_group_and_of_few_rows(spark):
    rows = [("one", 3.0)] + [("two", v) for v in (1.0, 2.0)] + [("none", None)] + [
        ("tie", v) for v in (0.0, 0.0, 0.0, 1.0, 2.0, 2.0, 5.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = exact_quantiles(df, ["x"], 4, [1, 2, 3], by=["g"]).toPandas()
    for name in ("one", "two", "tie"):
        data = [v for g, v in rows if g == name]
        part = got[got["g"] == name].sort_values("k")["quantile"]
        assert np.allclose(part, np.quantile(data, [0.25, 0.5, 0.75]))
    assert "none" not in set(got["g"])


def test_partition_number_does_not_matter(spark, skewed):
    _, df = skewed
    results = []
    for n in ("1", "4", "50"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            q = exact_quantiles(df, ["x"], 20).orderBy("k").collect()
            r = ranked(df, ["g"], ["x", "k"]).select("k", "rank").orderBy("k").collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        results.append((q, r))
    assert results[0] == results[1] == results[2]


def test_axis_index_on_both_paths(spark, monkeypatch):
    df = spark.createDataFrame([("LHC0002",), ("LHC0001",), ("LHC0002",), (None,)], "m string")
    want = [("LHC0001", 0), ("LHC0002", 1)]
    assert [tuple(r) for r in axis_index(df, "m", "i").orderBy("i").collect()] == want
    monkeypatch.setattr("canopanel.operators.ranking.BROADCAST_ROWS", 1)
    assert [tuple(r) for r in axis_index(df, "m", "i").orderBy("i").collect()] == want
