import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from canopanel.operators import diagnostics as diag
from canopanel.operators import ranking


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(5)
    n = 1500
    f = pd.DataFrame({"id": np.arange(n), "month": np.where(rng.random(n) < 0.6, 1, rng.integers(2, 5, n)),
                      "truth": rng.gamma(2.0, 3.0, n)})
    f["epis"] = np.round(rng.random(n), 1)  # many ties
    f["alea"] = rng.random(n)
    f["mu"] = f["truth"] + rng.normal(0, 1, n) * np.sqrt(f["epis"] + f["alea"])
    return f


@pytest.fixture(scope="module")
def pred(spark, frame):
    return spark.createDataFrame(frame).repartition(5).cache()


def test_metrics(pred, frame):
    r = diag.regression_metrics(pred).first()
    e = frame["truth"] - frame["mu"]
    assert r["r2"] == pytest.approx(1 - (e ** 2).sum() / ((frame["truth"] - frame["truth"].mean()) ** 2).sum())
    assert (r["mse"], r["rmse"], r["mae"]) == pytest.approx(((e ** 2).mean(), math.sqrt((e ** 2).mean()), e.abs().mean()))
    assert (r["truth_min"], r["truth_max"], r["n"]) == (frame["truth"].min(), frame["truth"].max(), len(frame))


def test_metrics_of_a_constant_truth_have_no_r2(spark):
    df = spark.createDataFrame([(1.0, 1.5), (1.0, 0.5)], "truth double, mu double")
    assert diag.regression_metrics(df).first()["r2"] is None


@pytest.mark.parametrize("bins", [20, 49, 50])
def test_histogram_equals_numpy(pred, frame, bins):
    got = diag.histogram(pred, ["truth", "mu"], bins).orderBy("feature", "bin").toPandas()
    pooled = np.concatenate([frame["truth"], frame["mu"]])
    for name in ("truth", "mu"):
        part = got[got["feature"] == name]
        counts, edges = np.histogram(frame[name], bins, (pooled.min(), pooled.max()))
        assert list(part["n"]) == list(counts)
        assert np.allclose(part["left"], edges[:-1]) and np.allclose(part["right"], edges[1:])


def test_maximum_is_in_the_last_bin_and_flat_columns_work(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.0,)], "x double")
    assert [r["n"] for r in diag.histogram(df, ["x"], 4).orderBy("bin").collect()] == [1, 0, 0, 2]
    flat = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [r["n"] for r in diag.histogram(flat, ["x"], 2).orderBy("bin").collect()] == [0, 2]


def test_histogram_2d_hides_rare_cells(pred, frame):
    got = {(r["x_bin"], r["y_bin"]): r["n"] for r in diag.histogram_2d(pred, "alea", "epis", 10).collect()}
    counts = np.histogram2d(frame["alea"], frame["epis"], 10)[0]
    assert got == {(i, j): counts[i, j] for i in range(10) for j in range(10) if counts[i, j] >= 7}


@pytest.mark.parametrize("bracket", [1e-3, 0.05, 0.6])
def test_discard_equals_pandas(pred, frame, monkeypatch, bracket):
    """With narrow brackets, wide ones, and ones that overlap."""
    monkeypatch.setattr(ranking, "BRACKET", bracket)
    got = {(r["month"], r["measure"], r["i"]): (r["kept"], r["rmse"])
           for r in diag.discard_test(pred, ["alea", "epis"], ["id"], ["month"]).collect()}
    assert len(got) == 4 * 2 * 11
    for month, part in frame.groupby("month"):
        for m in ("alea", "epis"):
            ordered = part.sort_values([m, "id"])
            for i in range(11):
                kept = ordered.iloc[:len(part) - i * len(part) // 20]
                want = math.sqrt(((kept["truth"] - kept["mu"]) ** 2).mean())
                assert got[month, m, i] == (len(kept), pytest.approx(want))


def test_discard_of_nothing_is_the_rmse_and_small_slices_work(spark, pred):
    overall = diag.discard_test(pred, ["alea"], ["id"]).where("i = 0").first()["rmse"]
    assert overall == pytest.approx(diag.regression_metrics(pred).first()["rmse"])
    three = diag.discard_test(pred.limit(3), ["alea"], ["id"])
    assert sorted(r["i"] for r in three.collect()) == list(range(11))
    assert [r["kept"] for r in three.orderBy("i").collect()] == [3 - i * 3 // 20 for i in range(11)]


def test_outliers_equal_pandas(pred, frame):
    q1, q3 = frame["truth"].quantile(0.25), frame["truth"].quantile(0.75)
    want = frame[(frame["truth"] < q1 - 1.5 * (q3 - q1)) | (frame["truth"] > q3 + 1.5 * (q3 - q1))]
    got = diag.iqr_outliers(pred, "truth")
    assert sorted(r["id"] for r in got.collect()) == sorted(want["id"])


def test_kde_integrates_to_almost_one(pred, frame):
    got = diag.kde(pred, "truth", 100).orderBy("i").toPandas()
    h = frame["truth"].std() * len(frame) ** -0.2
    at = got["x"].to_numpy()[:, None]
    want = np.exp(-0.5 * ((at - frame["truth"].to_numpy()) / h) ** 2).mean(axis=1) / (h * math.sqrt(2 * math.pi))
    assert np.allclose(got["density"], want)


def test_gaussian_fit(pred, frame):
    got = diag.gaussian_fit(pred, "truth").orderBy("i").toPandas()
    x = np.linspace(frame["truth"].min(), frame["truth"].max(), 500)
    sd = frame["truth"].std(ddof=0)
    want = np.exp(-0.5 * ((x - frame["truth"].mean()) / sd) ** 2) / (sd * math.sqrt(2 * math.pi))
    assert np.allclose(got["x"], x) and np.allclose(got["y"], want * len(frame) * np.ptp(frame["truth"]) / 50)


def test_correlations(pred, frame):
    names = ["truth", "mu", "alea"]
    got = {(r["a"], r["b"]): r["r"] for r in diag.corr_matrix(pred, names).collect()}
    want = frame[names].corr()
    assert got == pytest.approx({(a, b): want.loc[a, b] for a in names for b in names})


def test_interval_and_bias(pred, frame):
    r = diag.with_interval(pred).where("id = 7").first()
    row = frame.loc[7]
    assert r["upper"] - r["lower"] == pytest.approx(2 * 1.96 * math.sqrt(row["alea"] + row["epis"]))
    e = frame["mu"] - frame["truth"]
    assert diag.bias_variance(pred).first()[:] == pytest.approx((e.mean(), np.var(e)))


def test_pit_of_calibrated_predictions_is_flat(pred):
    got = diag.pit_histogram(pred, 10).orderBy("bin").collect()
    assert sum(r["n"] for r in got) == 1500 and all(0.7 < r["density"] < 1.3 for r in got)
    flags = diag.pit_flag(pred).agg(F.avg("pit_flag")).first()[0]
    assert 0.4 < flags < 0.6


def test_pit_without_variance_is_null(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0.0, 0.0)], "truth double, mu double, alea double, epis double")
    assert diag.pit(df).first()["pit"] is None


def test_slice_tables(pred, frame):
    table = diag.slice_compare(pred, "month", [1, 2]).toPandas().set_index("source")
    assert table.loc["truth", "1"] == pytest.approx(frame[frame["month"] == 1]["truth"].mean())
    long = diag.slice_uncertainty(pred, ["month"])
    assert long.count() == 8
