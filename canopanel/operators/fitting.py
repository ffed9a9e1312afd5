"""Data-parallel fit of evidential networks, one or one per slice, that can be resumed.

In each epoch every shard of rows makes mini-batch steps from the same starting weights, and the
shards' weights are averaged by row count (Zinkevich et al. 2010); with whole batches the shards
return gradients instead, and one step is made from their mean.  All slices train in one job.

Weights and optimizer moments are a table of (slice, block), written after each epoch; what
decides how a fit goes on (losses, learning rate, best epoch, patience) is a table of slices.  A
group of shards meets the weights of its own slice by key, and averages are combined as a tree: shards in
groups, groups in branches, then branches.  So nothing of all slices is collected, and their
weights are broadcast only where they have at most ``BROADCAST_BYTES``.  Rows are
bucketed by groups of shards once and are not moved again.  A fit whose folder holds epochs goes on
after the last complete one.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopanel.cluster import BROADCAST_BYTES, bucketed, shared_folder, stored
from canopanel.operators.evidential import (
    BLOCK, SHARD_ROWS, EvidentialModel, Network, block_rows, shards_of, vector_of)

_BRANCH = 32  # groups of shards whose averages are combined before they meet the others
_SPREAD = 128  # shards are grouped where there are twice as many or more
_GROUP_BYTES = 64 << 20  # of the numbers of a group's shards together, at most
_MOMENTS = "steps long, rate double, theta array<double>, first array<double>, second array<double>"
OPTIMIZERS = ("rmsprop", "adam")
_TABLES = {  # of an epoch; those of the first weights have no sums
    "weights": "slice string, block int, steps long, theta array<double>, first array<double>, second array<double>, "
               "known double, loss double",
    "control": "slice string, epoch int, train_loss double, val_loss double, val_mse double, learning_rate double, "
               "best_loss double, best_epoch int, stale int, next_rate double, active boolean"}


class _Rows:
    """Complete rows in shards, in a repeatable order, bucketed by groups of shards.

    A slice has as many shards as its rows need, dealt by key hash: a large slice is spread over
    tasks, a small one stays in one.  Where there are many shards, several of a slice lie together, up to
    ``_GROUP_BYTES``: such a group is read, gets its weights and returns their mean once, so that copies of weights
    and tasks hardly grow with the rows.  How many depends on the rows alone.  ``table`` has a row per shard with its
    numbers as bytes, so that an epoch neither sorts nor converts rows, in buckets of (slice, group).
    """

    def __init__(self, table: DataFrame, features, tasks, by, keys, shard_rows: int, seed: int):
        slices = (F.col(by).cast("string") if by else F.lit("")).alias("_slice")
        columns = [F.col(c).cast("double").alias(f"_{kind}{i}")
                   for kind, names in (("x", features), ("y", tasks)) for i, c in enumerate(names)]
        self.x, self.y = [[f"_{k}{i}" for i in range(len(n))] for k, n in (("x", features), ("y", tasks))]
        rows = table.select(F.xxhash64(F.lit(seed), *keys).alias("_h"), slices, *columns).dropna(subset=["_slice", *self.x])
        self.rows = stored(rows, "fit-rows")
        self.shards = stored(shards_of(self.rows, "_slice", shard_rows), "fit-shards")
        own = self.shards.select(F.col("slice").alias("_slice"), "shards")
        sharded = self.rows.join(own, "_slice").withColumn("_shard", F.pmod("_h", F.col("shards")).cast("int")).drop("shards")
        room = _GROUP_BYTES // (8 * shard_rows * (len(self.x) + len(self.y)))
        self.slices, total = _totals(self.shards)
        each = max(min(total // _SPREAD, room), 1)
        groups = self.shards.withColumn("shards", F.ceil(F.col("shards") / each).cast("int"))
        buckets = min(max(_totals(groups)[1], 1), 100_000)
        packed = sharded.groupBy("_slice", "_shard").applyInArrow(
            _packing(self.x, self.y), "_slice string, _shard int, _x binary, _y binary, _n int")
        self.table = bucketed(packed.withColumn("_group", F.floor(F.col("_shard") / each).cast("int")),
                              ["_slice", "_group"], buckets)
        places = groups.select("slice", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
        self.places = bucketed(places, ["slice", "shard"], buckets)

    def with_weights(self, weights: DataFrame, size: int, work, schema: str) -> DataFrame:
        """What ``work(slice, shard, x, y, weights of the slice)`` finds in each shard whose slice has weights.

        Rows with a ``vec`` are averaged within a group of shards, whose number they get as ``shard``.  Weights
        of ``size`` numbers a slice, where those of all slices are few, go to the groups' places and are not moved again.
        """
        def one(rows, state):
            import pyarrow as pa

            if not rows.num_rows or not state.num_rows:
                return pa.Table.from_pylist([], schema=arrow)
            rows = rows.sort_by("_shard")
            name, number = rows["_slice"][0].as_py(), rows["_group"][0].as_py()
            found = (work(name, rows["_shard"][i].as_py(), *_unpacked(rows, i), state) for i in range(rows.num_rows))
            return pa.Table.from_pylist(_group_mean(found, number), schema=arrow)

        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import _parse_datatype_string
        arrow = to_arrow_schema(_parse_datatype_string(schema))
        few = 8 * size * self.slices <= BROADCAST_BYTES
        messages = self.places.join(F.broadcast(weights) if few else weights, "slice")
        return self.table.groupBy("_slice", "_group").cogroup(messages.groupBy("slice", "shard")).applyInArrow(one, schema)


def _totals(shards: DataFrame) -> tuple[int, int]:
    """How many slices and shards there are."""
    slices, total = shards.agg(F.count("*"), F.sum("shards")).first()
    return slices, int(total or 0)


def _packing(x_names: list[str], y_names: list[str]):
    """Rows of one shard, in the order of their hash, as one row with the bytes of all features and of all targets."""
    def pack(rows):
        import pyarrow as pa

        x, y = ([np.asarray(rows[c].to_numpy(), dtype="<f8") for c in names] for names in (x_names, y_names))
        hashes = rows["_h"].to_numpy()
        order = np.argsort(hashes)
        if (np.diff(hashes[order]) == 0).any():  # rows of equal hashes are ordered by their numbers
            order = np.lexsort([*y[::-1], *x[::-1], hashes])
        x, y = (b"".join(c[order].tobytes() for c in columns) for columns in (x, y))
        return pa.table({
            "_slice": rows["_slice"].slice(0, 1), "_shard": rows["_shard"].slice(0, 1), "_x": pa.array([x], pa.binary()),
            "_y": pa.array([y], pa.binary()), "_n": pa.array([rows.num_rows], pa.int32())})

    return pack


def _unpacked(rows, i: int) -> list[np.ndarray]:
    """Features and targets of the shard in row ``i``, as (rows, columns) that lie column by column."""
    n = rows["_n"][i].as_py()
    return [np.frombuffer(rows[c][i].as_buffer(), "<f8").reshape(-1, n).T for c in ("_x", "_y")]


def _group_mean(parts, number: int) -> list[dict]:
    """Rows of several shards: those with a ``vec`` by their means, a running one at a time, others as they are."""
    plain, sums = [], {}
    for row in (row for part in parts for row in part):
        if "vec" not in row:
            plain.append(row)
        elif row["weight"] > 0:
            old = sums.get(row["block"])
            if old is None:
                sums[row["block"]] = {**row, "shard": number}
                continue
            weight = old["weight"] + row["weight"]
            old["vec"] = old["vec"] + (row["vec"] - old["vec"]) * (row["weight"] / weight)
            old |= {"weight": weight, "steps": max(old["steps"], row["steps"]),
                    "known": old["known"] + row["known"], "loss": old["loss"] + row["loss"]}
    return plain + list(sums.values())


def _local_steps(net: Network, batch_size: int, optimizer: str, seed: int):
    """Mini-batch steps over one shard from the slice's weights and moments."""
    def work(name, shard, x, y, state):
        theta, first, second = (vector_of(state, c) for c in ("theta", "first", "second"))
        steps, rate = state["steps"][0].as_py(), state["rate"][0].as_py()
        rng = np.random.default_rng([seed, int(shard), zlib.crc32(name.encode())])
        total = 0.0
        for at in range(0, len(x), batch_size):
            loss, grad = net.step(theta, x[at:at + batch_size], y[at:at + batch_size], rng)
            steps, total = steps + 1, total + loss
            keep, new = (0.999, 0.001) if optimizer == "adam" else (0.9, 0.1)
            second *= keep
            second += new * grad * grad
            if optimizer == "adam":
                first = 0.9 * first + 0.1 * grad
                theta -= rate * (first / (1 - 0.9 ** steps)) / (np.sqrt(second / (1 - 0.999 ** steps)) + 1e-7)
            else:
                theta -= rate * grad / (np.sqrt(second) + 1e-7)
        known = float((~np.isnan(y)).sum())
        packed = [block_rows(v) for v in (theta, first, second)]
        return [{"slice": name, "shard": shard, "block": b, "steps": steps, "vec": np.concatenate([p[b][1] for p in packed]),
                 "weight": float(len(x)), "known": known, "loss": total} for b, _ in packed[0]]

    return work


def _gradients(net: Network):
    """The gradient of one shard's mean loss; averaged by known targets it is that of the whole slice."""
    def work(name, shard, x, y, state):
        loss, grad = net.step(vector_of(state, "theta"), x, y, None)
        known = float((~np.isnan(y)).sum())
        return [{"slice": name, "shard": shard, "block": b, "steps": state["steps"][0].as_py() + 1, "vec": part,
                 "weight": known, "known": known, "loss": loss} for b, part in block_rows(grad)]

    return work


def _tree_mean(parts: DataFrame) -> DataFrame:
    """(slice, block, steps, vec, known, loss): means by weight, first of groups of shards, then of all."""
    def mean(df, *keys):
        vector = F.col("vec")
        return df.groupBy(*keys).agg(
            Summarizer.mean(vector, F.col("weight")).alias("vec"), F.sum("weight").alias("weight"),
            F.max("steps").alias("steps"), F.sum("known").alias("known"), F.sum("loss").alias("loss"))

    grouped = parts.where("weight > 0").withColumn("vec", array_to_vector("vec")).withColumn("branch", F.floor(F.col("shard") / _BRANCH))
    merged = mean(mean(grouped, "slice", "block", "branch"), "slice", "block")
    return merged.withColumn("vec", vector_to_array("vec"))


def _stepped(merged: DataFrame, state: DataFrame, optimizer: str) -> DataFrame:
    """One optimizer step of the whole slice from the mean gradient ``vec``."""
    old = state.select("slice", "block", "rate", "theta", "first", "second")
    both = merged.join(old, ["slice", "block"])
    keep = 0.999 if optimizer == "adam" else 0.9
    second = F.zip_with("second", "vec", lambda s, g: keep * s + (1 - keep) * g * g)
    first = F.zip_with("first", "vec", lambda f, g: 0.9 * f + 0.1 * g) if optimizer == "adam" else F.col("first")
    both = both.withColumns({"second": second, "first": first})
    if optimizer == "adam":
        at_first, at_second = 1 - F.pow(F.lit(0.9), F.col("steps")), 1 - F.pow(F.lit(0.999), F.col("steps"))
        move = F.zip_with("first", "second", lambda f, s: f / at_first / (F.sqrt(s / at_second) + 1e-7))
    else:
        move = F.zip_with("vec", "second", lambda g, s: g / (F.sqrt(s) + 1e-7))
    return both.withColumn("theta", F.zip_with("theta", move, lambda t, m: t - F.col("rate") * m))


class _Epochs:
    """The tables of a fit in its folder: weights and control of each epoch."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def path(self, kind: str, epoch: int) -> str:
        return f"{self.folder}/{kind}-{epoch:06d}"

    def read(self, kind: str, epoch: int) -> DataFrame:
        return self.spark.read.schema(_TABLES[kind]).parquet(self.path(kind, epoch))

    def write(self, kind: str, epoch: int, table: DataFrame) -> None:
        table.write.mode("overwrite").parquet(self.path(kind, epoch))

    def all_control(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/control-*")

    def last(self) -> int | None:
        """The last epoch whose control table, written last and as one file, is there."""
        try:
            return self.all_control().agg(F.max("epoch")).first()[0]
        except AnalysisException:  # no epoch yet
            return None


def _controlled(before: DataFrame, losses: DataFrame, scores: DataFrame, epoch: int, patience: int, min_rate: float) -> DataFrame:
    """The control table after an epoch: losses, best epoch, patience, next learning rate."""
    both = before.where("active").select("slice", "next_rate", "best_loss", "best_epoch", "stale").join(
        losses, "slice", "left").join(scores, "slice", "left")
    judged = F.coalesce("val_loss", "train_loss")
    better = F.coalesce(judged < F.col("best_loss"), F.lit(False))
    stale = F.when(better, 0).otherwise(F.col("stale") + 1)
    halve = (stale > 0) & (stale % max(patience // 2, 1) == 0)
    now = both.select(
        "slice", F.lit(epoch).alias("epoch"), "train_loss", "val_loss", "val_mse", F.col("next_rate").alias("learning_rate"),
        F.when(better, judged).otherwise(F.col("best_loss")).alias("best_loss"),
        F.when(better, F.lit(epoch)).otherwise(F.col("best_epoch")).alias("best_epoch"), stale.cast("int").alias("stale"),
        F.when(halve & (stale < patience), F.greatest(F.col("next_rate") / 2, F.lit(min_rate))).otherwise(F.col("next_rate")).alias("next_rate"),
        (stale < patience).alias("active"))
    # Slices that have stopped keep their last row, without an entry in the history.
    return now.unionByName(before.where("NOT active"))


def fit_evidential(
    train: DataFrame,
    val: DataFrame,
    features: Sequence[str],
    tasks: Sequence[str],
    keys: Sequence[str],
    by: str | None = None,
    epochs: int = 100,
    batch_size: int | None = 1024,
    learning_rate: float = 1e-3,
    patience: int = 10,
    min_learning_rate: float = 1e-6,
    shard_rows: int = SHARD_ROWS,
    optimizer: str = "rmsprop",
    seed: int = 0,
    folder: str | None = None,
    initial: np.ndarray | None = None,
    **network,
) -> EvidentialModel:
    """Fit one network, or one per value of ``by``, on columns ``features`` -> ``tasks``.

    A network stops after ``patience`` epochs without a better validation loss (without validation
    rows: training loss), its learning rate halves after ``patience // 2``, and the best weights are
    returned.  ``keys`` identify rows: they fix the row order and the shards of at most about
    ``shard_rows`` rows, so a fit is repeatable whatever the cluster.  ``batch_size=None`` makes one
    step an epoch from the gradient over all rows of a slice.  ``optimizer`` is ``"rmsprop"`` or ``"adam"``;
    its moments live on from epoch to epoch.

    ``folder`` (in shared storage; a new one unless given) takes the state of each epoch.  Where it
    holds epochs of the same fit already, only what is missing up to ``epochs`` is trained: the
    result equals that of a fit without a break.
    """
    if optimizer not in OPTIMIZERS:
        raise ValueError(f"unknown optimizer {optimizer!r}")
    features, tasks, spark = list(features), list(tasks), train.sparkSession
    net = Network(n_features=len(features), n_tasks=len(tasks), **network)
    rows = _Rows(train, features, tasks, by, keys, shard_rows, seed)
    held = _Rows(val, features, tasks, by, keys, shard_rows, seed)
    saved = _Epochs(spark, folder or shared_folder(spark, "fit"))
    work = _gradients(net) if batch_size is None else None
    width = "slice string, shard int, block int, steps long, vec array<double>, weight double, known double, loss double"

    last = saved.last()
    if last is None:  # epoch -1: every slice of the training rows with the same first weights
        start = net.initial(seed) if initial is None else initial
        blocks = spark.createDataFrame(
            [(b, part.tolist(), [0.0] * len(part)) for b, part in block_rows(start)], "block int, theta array<double>, zeros array<double>")
        first = rows.shards.select("slice").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((net.size - 1) // BLOCK))))
        saved.write("weights", 0, first.join(blocks, "block").select(
            "slice", "block", F.lit(0).cast("long").alias("steps"), "theta", F.col("zeros").alias("first"), F.col("zeros").alias("second")))
        none = F.lit(None).cast("double")
        saved.write("control", 0, rows.shards.select(
            "slice", F.lit(0).alias("epoch"), none.alias("train_loss"), none.alias("val_loss"), none.alias("val_mse"),
            none.alias("learning_rate"), F.lit(math.inf).alias("best_loss"), F.lit(0).alias("best_epoch"),
            F.lit(0).alias("stale"), F.lit(float(learning_rate)).alias("next_rate"), F.lit(True).alias("active")).coalesce(1))
        last = 0
    for epoch in range(last + 1, epochs + 1):
        before = saved.read("control", epoch - 1)
        active = before.where("active").select("slice", F.col("next_rate").alias("rate"))
        if active.isEmpty():
            break
        state = saved.read("weights", epoch - 1).join(active, "slice")
        steps = work or _local_steps(net, batch_size, optimizer, seed + 7919 * epoch)
        merged = _tree_mean(rows.with_weights(state, 3 * net.size, steps, width))
        if work:
            merged = _stepped(merged, state, optimizer)
        else:
            n = F.size("vec") / 3
            merged = merged.withColumns({
                c: F.slice("vec", (i * n + 1).cast("int"), n.cast("int")) for i, c in enumerate(("theta", "first", "second"))})
        saved.write("weights", epoch, merged.select("slice", "block", "steps", "theta", "first", "second", "known", "loss"))
        now = saved.read("weights", epoch)
        losses = now.where("block = 0").select("slice", F.try_divide("loss", "known").alias("train_loss"))
        scores = _validated(held, net, now.select("slice", "block", "theta"))
        control = _controlled(before, losses, scores, epoch, patience, min_learning_rate)
        saved.write("control", epoch, control.coalesce(1))
        last = epoch
    done = saved.read("control", last)
    history = saved.all_control().where("epoch > 0").dropDuplicates(["slice", "epoch"]).select(
        "slice", (F.col("epoch") - 1).alias("epoch"), "train_loss", "val_loss", "val_mse", "learning_rate")
    return EvidentialModel(net, features, tasks, _best_weights(saved, done, last), by, history, _variance(rows, tasks))


def _validated(rows: _Rows, net: Network, weights: DataFrame) -> DataFrame:
    """(slice, val_loss, val_mse); tasks return only sums."""
    def sums(name, shard, x, y, state):
        head = net.outputs(vector_of(state, "theta"), x)
        return [{"slice": name, "n": int((~np.isnan(y)).sum()), "loss": float(net.losses(head, y).sum()),
                 "sq": float(np.nansum((y - head[0]) ** 2))}]

    total = rows.with_weights(weights, net.size, sums, "slice string, n long, loss double, sq double").groupBy("slice").agg(
        F.sum("n").alias("n"), F.sum("loss").alias("loss"), F.sum("sq").alias("sq"))
    return total.select("slice", F.try_divide("loss", "n").alias("val_loss"), F.try_divide("sq", "n").alias("val_mse"))


def _best_weights(saved: _Epochs, done: DataFrame, last: int) -> DataFrame:
    """Each slice's weights of its best epoch; only epochs that are some slice's best are read."""
    found = None
    for epoch in sorted(r[0] for r in done.select("best_epoch").distinct().collect()):  # at most one number per epoch
        best = done.where(F.col("best_epoch") == epoch).select("slice")
        part = saved.read("weights", epoch).join(best, "slice", "left_semi").select("slice", "block", "theta")
        found = part if found is None else found.unionByName(part)
    return saved.read("weights", last).select("slice", "block", "theta").limit(0) if found is None else found


def _variance(rows: _Rows, tasks: list[str]) -> DataFrame:
    """(slice, task, variance) of the training targets."""
    wide = rows.rows.groupBy("_slice").agg(*[F.var_pop(c).alias(c) for c in rows.y])
    pairs = F.array(*[F.struct(F.lit(t).alias("task"), F.col(c).alias("variance")) for t, c in zip(tasks, rows.y)])
    return wide.select(F.col("_slice").alias("slice"), F.inline(pairs))
