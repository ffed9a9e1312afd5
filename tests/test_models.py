import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from canopanel.operators import evidential, sensitivity
from canopanel.operators.evidential import EvidentialModel, Network
from canopanel.operators.fitting import fit_evidential


def test_head_at_simple_values(spark):
    df = spark.createDataFrame([(3.0, 1.0, 2.0, 1.0)], "gamma double, nu double, alpha double, beta double")
    assert evidential.evidential_head(df).select("mu", "alea", "epis").first()[:] == (3.0, 1.0, 1.0)


def test_column_loss_equals_network_loss(spark):
    rng = np.random.default_rng(0)
    raw = pd.DataFrame({"y": rng.normal(size=50), "gamma": rng.normal(size=50), "nu": rng.gamma(2, size=50) + .1,
                        "alpha": 1.1 + rng.gamma(2, size=50), "beta": rng.gamma(2, size=50) + .1})
    net = Network(1, loss_weight=0.3)
    head = [raw[[c]].to_numpy() for c in ("gamma", "nu", "alpha", "beta")]
    want = net.losses(head, raw[["y"]].to_numpy()).mean()
    got = evidential.evidential_loss(spark.createDataFrame(raw), loss_weight=0.3).first()["loss"]
    assert got == pytest.approx(want)


@pytest.mark.parametrize("tasks, activation", [(1, "leaky_relu"), (3, "relu")])
def test_gradient_equals_finite_differences(tasks, activation):
    rng = np.random.default_rng(1)
    net = Network(4, tasks, hidden_layers=2, hidden_neurons=5, activation=activation, l2_weight=0.01, loss_weight=0.1)
    theta, x, y = net.initial(2), rng.normal(size=(9, 4)), rng.normal(size=(9, tasks))
    if tasks > 1:
        y[2, 1] = np.nan
    kernels = np.concatenate([np.concatenate([np.ones(i * o), np.zeros(o)]) for i, o in net.shapes])

    def objective(t):
        return (net.losses(net.outputs(t, x), y).sum() / (~np.isnan(y)).sum()
                + net.l2_weight * (kernels * t ** 2).sum())

    grad, eps = net.gradient(theta, x, y), 1e-6
    for i in rng.choice(net.size, 40, replace=False):
        step = np.zeros(net.size)
        step[i] = eps
        assert grad[i] == pytest.approx((objective(theta + step) - objective(theta - step)) / (2 * eps), abs=1e-5)


def test_unknown_activation():
    with pytest.raises(ValueError):
        Network(1, activation="tanh")


@pytest.fixture(scope="module")
def linear(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 2))
    frame = pd.DataFrame({"id": np.arange(3000), "x1": x[:, 0], "x2": x[:, 1],
                          "y": 2 * x[:, 0] - x[:, 1] + rng.normal(0, 0.1, 3000)})
    frame["season"] = np.where(rng.random(3000) < 0.7, "DJF", "JJA")
    frame["z"] = np.where(rng.random(3000) < 0.1, np.nan, -frame["y"])
    df = spark.createDataFrame(frame)
    return df.where("id < 2400"), df.where("id >= 2400")


OPTIONS = dict(hidden_layers=1, hidden_neurons=16, epochs=8, batch_size=64, learning_rate=0.01, l2_weight=0.0,
               shard_rows=600, seed=4)


@pytest.fixture(scope="module")
def fitted(linear):
    return fit_evidential(*linear, ["x1", "x2"], ["y"], ["id"], **OPTIONS)


def history_of(model):
    return [r.asDict() for r in model.history.orderBy("slice", "epoch").collect()]


def variance_of(model):
    return {(r["slice"], r["task"]): r["variance"] for r in model.variance.collect()}


def test_fit_recovers_a_linear_target(linear, fitted):
    history = history_of(fitted)
    losses = [h["val_loss"] for h in history]
    assert losses[-1] < losses[0] and min(h["val_mse"] for h in history) < 0.2
    scored = fitted.score(linear[1])
    assert scored.count() == linear[1].count()
    assert scored.select(F.corr("y", "mu")).first()[0] > 0.98
    assert scored.where("alea <= 0 OR epis <= 0 OR alea IS NULL").count() == 0
    assert variance_of(fitted)["", "y"] == pytest.approx(5.0, rel=0.15)


def test_fit_repeats_for_other_row_orders(linear, fitted):
    train, val = linear
    again = fit_evidential(train.repartition(11), val, ["x1", "x2"], ["y"], ["id"], **OPTIONS)
    assert np.allclose(again.vector(), fitted.vector(), rtol=1e-9, atol=1e-12)


def test_model_survives_storage(spark, linear, fitted, tmp_path):
    fitted.save(str(tmp_path / "model"))
    loaded = EvidentialModel.load(spark, str(tmp_path / "model"))
    assert (loaded.network, loaded.features) == (fitted.network, fitted.features)
    assert history_of(loaded) == history_of(fitted) and len(history_of(loaded)) == 8
    assert variance_of(loaded) == variance_of(fitted)
    assert np.array_equal(loaded.vector(), fitted.vector())
    flat = loaded.weights_table().where("layer = 1 AND kind = 'bias'").orderBy("pos").collect()
    assert np.array_equal([r["value"] for r in flat], fitted.network.layers(fitted.vector())[1][1])
    assert loaded.weights_table().count() == fitted.network.size


def test_one_job_fits_a_model_per_slice(linear):
    model = fit_evidential(*linear, ["x1", "x2"], ["y"], ["id"], by="season", **OPTIONS)
    assert {r["slice"] for r in model.weights.select("slice").collect()} == {"DJF", "JJA"}
    assert not np.allclose(model.vector("DJF"), model.vector("JJA"))
    assert model.score(linear[1]).groupBy("season").agg(F.corr("y", "mu").alias("r")).where("r > 0.9").count() == 2


def test_many_tasks_with_missing_targets(linear):
    model = fit_evidential(*linear, ["x1", "x2"], ["y", "z"], ["id"], **OPTIONS)
    scored = model.score(linear[1])
    assert scored.count() == 2 * linear[1].count()
    means = {r["task"]: r["r"] for r in scored.groupBy("task").agg(F.corr("y", "mu").alias("r")).collect()}
    assert means["y"] > 0.9 and means["z"] < -0.9


def test_early_stop_and_learning_rate(linear):
    model = fit_evidential(*linear, ["x1", "x2"], ["y"], ["id"], **{
        **OPTIONS, "learning_rate": 5.0, "epochs": 12, "patience": 2})
    rates = [h["learning_rate"] for h in history_of(model)]
    assert len(rates) < 12 and rates[-1] < rates[0]


def test_dropout_and_noise_still_learn(linear):
    model = fit_evidential(*linear, ["x1", "x2"], ["y"], ["id"], **{
        **OPTIONS, "epochs": 4, "hidden_neurons": 32, "dropout": 0.2, "noise_sd": 0.01})
    history = history_of(model)
    assert history[-1]["val_loss"] < history[0]["val_loss"]


def test_rows_without_features_or_model_score_null(spark, linear):
    model = fit_evidential(*linear, ["x1", "x2"], ["y"], ["id"], by="season", **{**OPTIONS, "epochs": 1})
    rows = spark.createDataFrame([("DJF", 1.0, None), ("SON", 1.0, 1.0), ("DJF", 1.0, 1.0)],
                                 "season string, x1 double, x2 double")
    assert sorted((r["season"], r["mu"] is None) for r in model.score(rows).collect()) == [
        ("DJF", False), ("DJF", True), ("SON", True)]


# ---- sensitivity ---------------------------------------------------------------------------

N, M = 4097, 4
BOUNDS = [(f"x{i}", -math.pi, math.pi) for i in (1, 2, 3)]


@pytest.fixture(scope="module")
def ishigami(spark):
    points = sensitivity.fast_sample(spark, BOUNDS, N, M, seed=0)
    y = F.sin("x1") + 7 * F.pow(F.sin("x2"), 2) + 0.1 * F.pow("x3", F.lit(4)) * F.sin("x1")
    return points.select("curve", "n", y.alias("y")).cache()


def test_sample_follows_the_search_curve(spark):
    own, others = sensitivity.frequencies(3, 257, 2)
    points = sensitivity.fast_sample(spark, [("a", 0, 1), ("b", 0, 1), ("c", 0, 1)], 257, 2, seed=3).toPandas()
    assert len(points) == 3 * 257 and points[["a", "b", "c"]].to_numpy().min() >= 0
    phase = sensitivity.phases(3, 3)
    part = points[points["curve"] == "b"].sort_values("n")
    s = 2 * np.pi * part["n"] / 257
    for name, omega in (("b", own), ("a", others[0]), ("c", others[1])):
        want = 0.5 + np.arcsin(np.sin(omega * s + 2 * np.pi * phase[1])) / np.pi
        assert np.allclose(part[name], want, atol=1e-6)


def test_ishigami_indices(ishigami):
    got = {r["name"]: r for r in sensitivity.fast_indices(ishigami, M).collect()}
    for name, first, total in (("x1", 0.314, 0.558), ("x2", 0.442, 0.442), ("x3", 0.0, 0.244)):
        assert got[name]["S1"] == pytest.approx(first, abs=0.06)
        assert got[name]["ST"] == pytest.approx(total, abs=0.08)


@pytest.mark.parametrize("n", [4097, 4096])
def test_sums_and_transform_agree(spark, n):
    points = sensitivity.fast_sample(spark, BOUNDS, n, M)
    outputs = points.select("curve", "n", (F.sin("x1") + F.col("x2") * F.col("x3")).alias("y"))
    a = {r["name"]: r["S1"] for r in sensitivity.fast_first_order(outputs, n, M).collect()}
    b = {r["name"]: r["S1"] for r in sensitivity.fast_indices(outputs, M).collect()}
    assert a == pytest.approx(b, rel=1e-9)


def test_bootstrap_is_repeatable(ishigami):
    def run(df):
        return sensitivity.fast_indices(df, M, n_bootstrap=30, seed=1).orderBy("name").collect()
    first, second = run(ishigami), run(ishigami.repartition(7))
    for a, b in zip(first, second, strict=True):  # draws are equal; sums differ in their last bits
        assert a["name"] == b["name"] and [*a][1:] == pytest.approx([*b][1:], rel=1e-9)
    assert all(0 < r["S1_conf"] < 0.2 and 0 < r["ST_conf"] for r in first)


@pytest.mark.parametrize("n", [1000, 1001])
def test_bootstrap_equals_plain_weighted_sums(spark, n):
    """In blocks and in one: the deviation of indices from sums over all terms with the drawn weights."""
    rng = np.random.default_rng(3)
    own = (n - 1) // (2 * M)
    at = np.arange(n)
    y = 5 + rng.normal(size=n) + np.sin(2 * np.pi * at * own / n) + 0.5 * np.sin(2 * np.pi * at * 3 / n)
    outputs = spark.createDataFrame(pd.DataFrame({"curve": "p", "n": at, "y": y}))
    first, total = [], []
    for w in sensitivity.draw_weights(np.arange(20), at, 7):
        z = w * (y - y.mean())
        terms = np.abs(np.fft.fft(z)) ** 2
        all_of_it = w.sum() * (w * (y - y.mean()) ** 2).sum() - z.sum() ** 2
        first.append(2 * terms[np.arange(1, M + 1) * own].sum() / all_of_it)
        total.append(1 - 2 * terms[1:own // 2 + 1].sum() / all_of_it)
    for block in (1 << 16, 130):
        got = sensitivity.fast_indices(outputs, M, n_bootstrap=20, seed=7, chunks=3, block=block).first()
        assert got["S1_conf"] == pytest.approx(1.959964 * np.std(first, ddof=1), rel=1e-5)
        assert got["ST_conf"] == pytest.approx(1.959964 * np.std(total, ddof=1), rel=1e-5)


def test_draws_are_poisson_and_free_of_each_other():
    w = sensitivity.draw_weights(np.arange(200), np.arange(5000))
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - math.exp(-1)) < 0.005
    assert abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.05 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.2
    assert not np.array_equal(w[:3], sensitivity.draw_weights(np.arange(3), np.arange(5000), seed=1))


def test_slices_are_analysed_apart(ishigami):
    tripled = ishigami.select("curve", "n", F.lit("b").alias("s"), (F.col("y") * 3).alias("y"))
    both = ishigami.withColumn("s", F.lit("a")).unionByName(tripled)
    got = sensitivity.fast_indices(both, M, by=["s"]).toPandas().pivot(index="name", columns="s", values="S1")
    assert np.allclose(got["a"], got["b"])


def test_ranking(spark):
    sens = spark.createDataFrame([("a", 0.1, 0.9), ("b", 0.5, 0.6), ("c", 0.5, 0.5), ("d", 0.0, 0.1), ("e", 0.2, 0.2)],
                                 "name string, S1 double, ST double")
    assert [r["name"] for r in sensitivity.rank_indices(sens).orderBy("rank").collect()] == list("bcead")
    assert [r["name"] for r in sensitivity.top_indices(sens, 4).orderBy("rank").collect()] == list("abce")


def test_sample_size_is_checked():
    with pytest.raises(ValueError):
        sensitivity.frequencies(3, 64, 4)


def test_adam_and_missing_targets(linear):
    """Train and validation losses of the same rows agree although half of one target is missing."""
    train, _ = linear
    model = fit_evidential(train, train, ["x1", "x2"], ["y", "z"], ["id"], hidden_layers=1, hidden_neurons=4, epochs=2,
                           batch_size=100_000, learning_rate=1e-9, l2_weight=0.0, seed=1, optimizer="adam")
    history = history_of(model)
    assert history[0]["train_loss"] == pytest.approx(history[0]["val_loss"], rel=1e-4)
    by_slice = fit_evidential(train, train, ["x1", "x2"], ["y"], ["id"], by="season", hidden_layers=1, hidden_neurons=4,
                              epochs=6, batch_size=64, learning_rate=0.01, optimizer="adam", shard_rows=500)
    assert set(variance_of(by_slice)) == {("DJF", "y"), ("JJA", "y")}
    history = history_of(by_slice)
    assert history[-1]["val_loss"] < history[0]["val_loss"]
    with pytest.raises(ValueError):
        fit_evidential(train, train, ["x1"], ["y"], ["id"], optimizer="sgd")


def _orders(y, harmonics):
    """Both indices of one whole curve."""
    n = len(y)
    own = (n - 1) // (2 * harmonics)
    power = np.abs(np.fft.rfft(y)[1:(n + 1) // 2]) ** 2
    return power[np.arange(1, harmonics + 1) * own - 1].sum() / power.sum(), 1 - power[:own // 2].sum() / power.sum()


def test_curves_transformed_in_blocks(spark):
    from canopanel.operators import sensitivity
    rng = np.random.default_rng(2)
    for n in (1000, 1001):
        y = rng.normal(size=n) + np.sin(2 * np.pi * np.arange(n) * ((n - 1) // 8) / n)
        outputs = spark.createDataFrame(pd.DataFrame({"curve": "p", "n": np.arange(n), "y": y}))
        want = _orders(y, 4)
        for block in (1 << 16, 77):
            got = sensitivity.fast_indices(outputs, block=block).first()
            assert (got["S1"], got["ST"]) == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("batch_size, optimizer", [(64, "rmsprop"), (64, "adam"), (None, "adam")])
def test_a_resumed_fit_equals_an_uninterrupted_one(linear, tmp_path, batch_size, optimizer):
    """A fit stopped after two epochs, then at an epoch whose control table was lost, and gone on with."""
    import shutil
    options = {**OPTIONS, "epochs": 5, "batch_size": batch_size, "optimizer": optimizer, "by": "season", "patience": 2}
    whole = fit_evidential(*linear, ["x1", "x2"], ["y"], ["id"], **options)
    folder = str(tmp_path / "fit")
    fit_evidential(*linear, ["x1", "x2"], ["y"], ["id"], folder=folder, **{**options, "epochs": 2})
    fit_evidential(*linear, ["x1", "x2"], ["y"], ["id"], folder=folder, **{**options, "epochs": 3})
    shutil.rmtree(f"{folder}/control-000003")
    again = fit_evidential(*linear, ["x1", "x2"], ["y"], ["id"], folder=folder, **options)
    key = lambda h: (h["slice"], h["epoch"], h["val_loss"], h["learning_rate"])
    assert np.allclose([key(h)[1:] for h in history_of(again)], [key(h)[1:] for h in history_of(whole)], rtol=1e-9)
    for name in ("DJF", "JJA"):
        assert np.allclose(again.vector(name), whole.vector(name), rtol=1e-9, atol=1e-12)


def test_whole_batches_make_the_step_of_the_whole_gradient(linear):
    """Shards' gradients, weighted by their known targets, are the gradient over all rows."""
    train, val = linear
    start = Network(2, 2, 1, 5).initial(3)
    model = fit_evidential(train, val, ["x1", "x2"], ["y", "z"], ["id"], epochs=1, batch_size=None, learning_rate=0.1,
                           shard_rows=300, hidden_layers=1, hidden_neurons=5, initial=start)
    rows = train.toPandas()
    grad = model.network.gradient(start, rows[["x1", "x2"]].to_numpy(), rows[["y", "z"]].to_numpy())
    want = start - 0.1 * grad / (np.sqrt(0.1 * grad**2) + 1e-7)
    assert np.allclose(model.vector(), want, rtol=1e-7, atol=1e-9)


def test_a_large_slice_is_scored_in_shards(spark, monkeypatch):
    monkeypatch.setattr(evidential, "SHARD_ROWS", 100)
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"id": np.arange(900), "x1": rng.normal(size=900), "x2": rng.normal(size=900)})
    frame["season"] = ["DJF" if i % 9 else None for i in range(900)]
    net = Network(2, hidden_layers=1, hidden_neurons=3)
    one = EvidentialModel.of_vector(spark, net, ["x1", "x2"], ["y"], net.initial(1))
    many = EvidentialModel(net, ["x1", "x2"], ["y"], one.weights.withColumn("slice", F.lit("DJF")), "season")
    rows = spark.createDataFrame(frame)
    got = {r["id"]: r["mu"] for r in many.score(rows).collect()}
    want = {r["id"]: r["mu"] if r["season"] else None for r in one.score(rows).collect()}
    assert len(got) == 900 and got == pytest.approx(want)
