"""Fits and scoring on many rows: what is held, moved and worked out."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopanel.operators import evidential, fitting, scaling
from canopanel.operators.evidential import EvidentialModel, Network

OPTIONS = dict(hidden_layers=1, hidden_neurons=4, epochs=2, batch_size=32, seed=3)


def table_of(spark, n: int):
    return spark.range(n).select(
        "id", (F.col("id") % 17 / 17).alias("x1"), (F.col("id") % 5 / 5).alias("x2"), (F.col("id") % 3).cast("string").alias("s"),
        (F.col("id") % 17 / 17 - F.col("id") % 5 / 5).alias("y"))


def test_scoring_holds_a_block_of_each_layer_only():
    net = Network(n_features=8, hidden_layers=6)
    theta, x = net.initial(1), np.ones((20_000, 8))
    tracemalloc.start()
    try:
        net.outputs(theta, x)
        assert tracemalloc.get_traced_memory()[1] < 8 * x.nbytes
    finally:
        tracemalloc.stop()


def test_a_step_in_blocks_has_the_gradient_of_the_batch():
    rng = np.random.default_rng(0)
    net = Network(n_features=3, n_tasks=2, hidden_layers=2, hidden_neurons=8)
    theta, x, y = net.initial(1), rng.normal(size=(700, 3)), rng.normal(size=(700, 2))
    y[rng.random(y.shape) < 0.5] = np.nan
    loss, grad = net.step(theta, x, y)
    parts = [(net.step(theta, x[i:i + 100], y[i:i + 100]), int((~np.isnan(y[i:i + 100])).sum())) for i in range(0, 700, 100)]
    assert loss == pytest.approx(sum(p[0] for p, _ in parts), rel=1e-12)
    assert np.allclose(grad, sum(p[1] * n for p, n in parts) / sum(n for _, n in parts), rtol=1e-9, atol=1e-12)
    assert loss == pytest.approx(net.losses(net.outputs(theta, x), y).sum(), rel=1e-12)


def test_scores_of_a_row_table_match_the_network(spark):
    net = Network(n_features=2, n_tasks=2, hidden_layers=1, hidden_neurons=4)
    theta = net.initial(1)
    model = EvidentialModel.of_vector(spark, net, ["x1", "x2"], ["a", "b"], theta)
    rows = model.score(table_of(spark, 500)).orderBy("id", "task").toPandas()
    head = net.outputs(theta, rows.loc[rows.task == "a", ["x1", "x2"]].to_numpy())
    for at, task in enumerate("ab"):
        assert np.allclose(rows.loc[rows.task == task, "mu"], head[0][:, at])


def test_many_shards_return_one_mean_a_group(spark, monkeypatch):
    """Weights move once a group of shards, an epoch reads a row per shard, and the fit stays that of single shards."""
    table = table_of(spark, 2000)
    single = fitting.fit_evidential(table, table, ["x1", "x2"], ["y"], ["id"], shard_rows=50, **OPTIONS)
    seen = []
    monkeypatch.setattr(fitting, "_SPREAD", 10)
    tree = fitting._tree_mean
    monkeypatch.setattr(fitting, "_tree_mean", lambda parts: seen.append(parts.count()) or tree(parts))
    grouped = fitting.fit_evidential(table, table, ["x1", "x2"], ["y"], ["id"], shard_rows=50, **OPTIONS)
    assert seen == [10, 10]  # 40 shards
    assert np.allclose(grouped.vector(), single.vector(), rtol=1e-9, atol=1e-12)
    rows = fitting._Rows(table, ["x1", "x2"], ["y"], None, ["id"], 50, 3)
    assert rows.table.count() == 40 and rows.table.agg(F.sum("_n")).first()[0] == 2000


def test_heads_are_worked_out_for_known_targets_only(monkeypatch):
    rng = np.random.default_rng(0)
    net = Network(n_features=3, n_tasks=25, hidden_layers=1, hidden_neurons=8)
    x, y = rng.normal(size=(200, 3)), rng.normal(size=(200, 25))
    y[rng.random(y.shape) < 0.75] = np.nan
    sizes, soft = [], evidential._softplus
    monkeypatch.setattr(evidential, "_softplus", lambda z: sizes.append(z.size) or soft(z))
    loss, _ = net.step(net.initial(1), x, y)
    assert sum(sizes) == 3 * int((~np.isnan(y)).sum())
    monkeypatch.undo()
    assert loss == pytest.approx(net.losses(net.outputs(net.initial(1), x), y).sum(), rel=1e-12)


def test_groups_of_shards_do_not_grow_with_the_rows(spark, monkeypatch):
    """Rows ten times as many lie in larger groups, not in more, unless a group's numbers would be too many."""
    monkeypatch.setattr(fitting, "_SPREAD", 10)
    def groups(n):
        rows = fitting._Rows(table_of(spark, n), ["x1", "x2"], ["y"], None, ["id"], 5, 3)
        return rows.table.select("_slice", "_group").distinct().count(), rows.table.agg(F.sum("_n")).first()[0]
    assert groups(200) == (10, 200)
    assert groups(2000) == (10, 2000)
    monkeypatch.setattr(fitting, "_GROUP_BYTES", 4 * 5 * 3 * 8)
    assert groups(2000) == (100, 2000)


def test_few_weights_reach_their_shards_without_an_exchange(spark, capsys):
    rows = fitting._Rows(table_of(spark, 600), ["x1", "x2"], ["y"], "s", ["id"], 50, 3)
    weights = spark.createDataFrame([(s, 0, [1.0, 2.0]) for s in "012"], "slice string, block int, theta array<double>")
    def seen(name, shard, x, y, state):
        return [{"slice": name, "n": len(x), "theta": state["theta"][0].as_py()}]
    for size, moved in ((2, False), (1 << 40, True)):
        found = rows.with_weights(weights, size, seen, "slice string, n long, theta array<double>")
        found.explain()
        assert ("Exchange hashpartitioning" in capsys.readouterr().out) == moved
        got = found.groupBy("slice").agg(F.sum("n").alias("n")).collect()
        assert {(r["slice"], r["n"]) for r in got} == {("0", 200), ("1", 200), ("2", 200)}


def test_shards_are_packed_alike_whatever_the_order_of_their_rows():
    import pyarrow as pa
    rng = np.random.default_rng(1)
    rows = pa.table({"_slice": ["a"] * 60, "_shard": [0] * 60, "_h": rng.integers(0, 9, 60), "_x0": rng.normal(size=60),
                     "_y0": [None if i % 4 == 0 else float(i % 7) for i in range(60)]})
    pack = fitting._packing(["_x0"], ["_y0"])
    first, again = pack(rows), pack(rows.take(rng.permutation(60)))
    assert first.equals(again)
    x, y = fitting._unpacked(first, 0)
    assert np.array_equal(x[:, 0], rows.sort_by([("_h", "ascending"), ("_x0", "ascending")])["_x0"].to_numpy())
    assert np.isnan(y).sum() == 15


def test_a_batch_goes_through_in_blocks_of_one_size(monkeypatch):
    net, sizes = Network(n_features=2, hidden_layers=1, hidden_neurons=4), []
    add = Network._add_gradient
    monkeypatch.setattr(Network, "_add_gradient", lambda self, a, b, x, *rest: sizes.append(len(x)) or add(self, a, b, x, *rest))
    for n in (500, 1200):
        net.step(net.initial(1), np.ones((n, 2)), np.ones((n, 1)))
    assert sizes == [250] * 2 + [300] * 4


def test_scaled_rows_carry_no_moments_and_do_not_work_them_out_again(spark, capsys):
    table = table_of(spark, 60).withColumn("constant", F.lit(4.0)).withColumn("none", F.lit(None).cast("double"))
    columns = ["x1", "y", "constant", "none"]
    moments = scaling.fit_standard(table, columns)
    scaled = scaling.standard_scale(table, moments, columns)
    scaled.explain()
    plan = capsys.readouterr().out
    assert "Subquery" not in plan and "Aggregate" not in plan and "_m" not in plan
    found = scaled.agg(F.avg("x1"), F.stddev_pop("y"), F.max("constant"), F.count("none")).first()
    assert found[:] == (pytest.approx(0.0, abs=1e-12), pytest.approx(1.0), 0.0, 0)
    back = scaling.inverse_scale(scaled, moments, columns).join(table.select("id", F.col("y").alias("want")), "id")
    assert back.where("abs(y - want) > 1e-12 OR constant <> 4").count() == 0
    with pytest.raises(ValueError):
        scaling.standard_scale(table, moments.union(moments), columns)
