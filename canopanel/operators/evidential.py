"""Evidential regression: head, loss, the network of a task, and scoring with fitted weights.

The network predicts a Normal-Inverse-Gamma distribution (gamma, nu, alpha, beta) per
output (Amini et al. 2020).  Weights of many slices are a table of (slice, block, theta) that is
never collected: rows meet the weights of their own slice by key.  ``fitting`` has the fit.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopanel.cluster import join_on_keys, stored
from canopanel.functions.special import lgamma
from canopanel.schema import nan_to_null

SHARD_ROWS = 16_384  # rows of one slice that one task holds
BLOCK = 4096  # weights per row of a table of weights
STEP_ROWS = 300  # rows of a batch that go through the network at once, at most


# ---- column expressions -------------------------------------------------------------

def evidential_head(table: DataFrame, gamma: str = "gamma", nu: str = "nu", alpha: str = "alpha",
                    beta: str = "beta") -> DataFrame:
    """Adds ``mu``, ``alea = beta / (alpha - 1)`` and ``epis = beta / (nu (alpha - 1))``."""
    a1 = F.col(alpha) - 1
    return table.withColumns({
        "mu": F.col(gamma),
        "alea": F.try_divide(F.col(beta), a1),
        "epis": F.try_divide(F.col(beta), F.col(nu) * a1),
    })


def nig_loss(y: Column, gamma: Column, nu: Column, alpha: Column, beta: Column,
             loss_weight: float = 0.0) -> Column:
    """Negative log likelihood plus ``loss_weight * |y - gamma| * (2 nu + alpha)``."""
    error = y - gamma
    omega = 2 * beta * (1 + nu)
    nll = (0.5 * F.log(math.pi / nu) - alpha * F.log(omega)
           + (alpha + 0.5) * F.log(nu * error * error + omega)
           + lgamma(alpha) - lgamma(alpha + 0.5))
    return nll + loss_weight * F.abs(error) * (2 * nu + alpha)


def evidential_loss(table: DataFrame, keys: Sequence[str] = (), loss_weight: float = 0.0,
                    y: str = "y") -> DataFrame:
    """Mean loss over a table of raw outputs, overall or per group."""
    loss = nig_loss(*[F.col(c) for c in (y, "gamma", "nu", "alpha", "beta")], loss_weight)
    return table.groupBy(*keys).agg(F.avg(loss).alias("loss"), F.count("*").alias("n"))


# ---- the small network each task runs on its own batches -----------------------------

@dataclass(frozen=True)
class Network:
    """Shape and training settings of a dense evidential network."""

    n_features: int
    n_tasks: int = 1
    hidden_layers: int = 4
    hidden_neurons: int = 64
    activation: str = "leaky_relu"
    l2_weight: float = 1e-3
    loss_weight: float = 1e-4
    dropout: float = 0.0
    noise_sd: float = 0.0

    def __post_init__(self):
        if self.activation not in ("relu", "leaky_relu"):
            raise ValueError(f"unknown activation {self.activation!r}")

    @property
    def shapes(self) -> list[tuple[int, int]]:
        widths = [self.n_features, *[self.hidden_neurons] * self.hidden_layers, 4 * self.n_tasks]
        return list(zip(widths, widths[1:]))

    @property
    def size(self) -> int:
        return sum((i + 1) * o for i, o in self.shapes)

    def initial(self, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        parts = []
        for i, o in self.shapes:
            limit = math.sqrt(6.0 / (i + o))
            parts += [rng.uniform(-limit, limit, i * o), np.zeros(o)]
        return np.concatenate(parts)

    def layers(self, theta: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(weights, bias) views into the flat weight vector."""
        out, at = [], 0
        for i, o in self.shapes:
            out.append((theta[at:at + i * o].reshape(i, o), theta[at + i * o:at + (i + 1) * o]))
            at += (i + 1) * o
        return out

    @property
    def _slope(self) -> float:
        return 0.2 if self.activation == "leaky_relu" else 0.0

    def _affine(self, theta: np.ndarray) -> list[np.ndarray]:
        """Views of each layer's weights with its bias as their last row: units, and a one, lie in rows."""
        out, at = [], 0
        for i, o in self.shapes:
            out.append(theta[at:at + (i + 1) * o].reshape(i + 1, o))
            at += (i + 1) * o
        return out

    def raw(self, theta: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Last layer's output, block by block of rows."""
        layers, rows = self._affine(theta), min(len(x), STEP_ROWS)
        first, (even, odd, scratch) = self._inputs(rows), self._space(rows, 3)
        out = np.empty((4 * self.n_tasks, len(x)))
        for at in range(0, len(x), STEP_ROWS):
            part = x[at:at + STEP_ROWS]
            h = first[:, :len(part)]
            h[:-1] = part.T
            for number, layer in enumerate(layers[:-1]):
                h = self._activated(h, layer, odd if number % 2 else even, scratch)
            np.matmul(layers[-1].T, h, out=out[:, at:at + STEP_ROWS])
        return out.T

    def _inputs(self, rows: int) -> np.ndarray:
        """Space for features in rows, with a last row of ones."""
        return np.ones((self.n_features + 1, rows))

    def _space(self, rows: int, arrays: int) -> list[np.ndarray]:
        """Arrays of hidden units in rows, with a last row of ones, that all blocks write to."""
        out = [np.empty((self.hidden_neurons + 1, rows)) for _ in range(arrays)]
        for a in out:
            a[-1] = 1.0
        return out

    def _activated(self, h, layer, out, scratch) -> np.ndarray:
        """A hidden layer's activation above its row of ones, written to ``out``; its sign tells the derivative."""
        out = out[:, :h.shape[1]]
        z = np.matmul(layer.T, h, out=out[:-1])
        np.maximum(z, np.multiply(z, self._slope, out=scratch[:-1, :h.shape[1]]) if self._slope else 0.0, out=z)
        return out

    def _dropped(self, a: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray | None]:
        """An activation after dropout and noise, and what dropout kept; draws are made row of the batch by row."""
        keep, shape = None, (a.shape[1], a.shape[0] - 1)
        if rng is None or not (self.dropout or self.noise_sd):
            return a, keep
        a = a.copy()
        if self.dropout:
            keep = ((rng.random(shape) >= self.dropout) / (1.0 - self.dropout)).T
            a[:-1] *= keep
        if self.noise_sd:
            a[:-1] += rng.normal(0.0, self.noise_sd, shape).T
        return a, keep

    def outputs(self, theta: np.ndarray, x: np.ndarray):
        """gamma, nu, alpha, beta as (rows, tasks) arrays."""
        return self._head(self.raw(theta, x))

    def _head(self, o: np.ndarray):
        g, n, a, b = np.split(o, 4, axis=1)
        return g, _softplus(n) + 1e-6, _softplus(a) + 1 + 1e-6, _softplus(b) + 1e-6

    def losses(self, head, y: np.ndarray) -> np.ndarray:
        """Loss per row and task; 0 where the target is missing."""
        g, nu, al, be = head
        e = np.where(np.isnan(y), 0.0, y - g)
        om = 2 * be * (1 + nu)
        nll = (0.5 * np.log(np.pi / nu) - al * np.log(om) + (al + 0.5) * np.log(nu * e * e + om)
               + _lgamma(al) - _lgamma(al + 0.5))
        return np.where(np.isnan(y), 0.0, nll + self.loss_weight * np.abs(e) * (2 * nu + al))

    def gradient(self, theta: np.ndarray, x: np.ndarray, y: np.ndarray, rng=None) -> np.ndarray:
        """Gradient of the batch's mean loss plus the L2 term."""
        return self.step(theta, x, y, rng)[1]

    def step(self, theta: np.ndarray, x: np.ndarray, y: np.ndarray, rng=None) -> tuple[float, np.ndarray]:
        """Sum of the batch's losses and the gradient of their mean plus the L2 term, of one forward pass.

        The batch goes through in blocks of rows that stay in a core's cache; their gradients add up.
        """
        drawn = rng is not None and (self.dropout or self.noise_sd)  # draws go through the whole batch, layer by layer
        rows = len(x) if drawn else -(-len(x) // max(-(-len(x) // STEP_ROWS), 1))  # blocks of one size
        grad = np.zeros_like(theta)
        layers, views = self._affine(theta), self._affine(grad)
        first, space = self._inputs(rows), self._space(rows, 3 + self.hidden_layers)
        known = ~np.isnan(y)
        share, loss = 1.0 / max(int(known.sum()), 1), 0.0
        for at in range(0, len(x), max(rows, 1)):
            block = slice(at, at + rows)
            loss += self._add_gradient(layers, views, x[block], y[block].T, known[block].T, share, rng, first, space)
        for w, g in zip(layers, views):
            g[:-1] += 2 * self.l2_weight * w[:-1]
        return loss, grad

    def _add_gradient(self, layers, views, x, y, known, share: float, rng, first, space) -> float:
        """Adds ``share`` of the block's summed gradient to ``views``; the sum of its losses."""
        rows = len(x)
        scratch, deltas, trace = space[0], [a[:-1, :rows] for a in space[1:3]], []
        h = first[:, :rows]
        h[:-1] = x.T
        for layer, out in zip(layers[:-1], space[3:]):
            active = self._activated(h, layer, out, scratch)
            after, keep = self._dropped(active, rng)
            trace.append((h, active, keep))
            h = after
        loss, delta = self._head_gradient(np.matmul(layers[-1].T, h), y, known)
        delta *= share
        factor = scratch[:-1, :rows]
        for number in range(len(layers) - 1, -1, -1):
            views[number] += np.matmul(trace[number][0] if number < len(trace) else h, delta.T)
            if number:
                _, active, keep = trace[number - 1]
                delta = np.matmul(layers[number][:-1], delta, out=deltas[number % 2])
                np.greater(active[:-1], 0.0, out=factor)
                if self._slope:
                    np.maximum(factor, self._slope, out=factor)
                delta *= factor
                if keep is not None:
                    delta *= keep
        return loss

    def _head_gradient(self, o: np.ndarray, y: np.ndarray, known: np.ndarray) -> tuple[float, np.ndarray]:
        """Sum of losses and their derivatives by the outputs, worked out for known targets only: others have none.

        Outputs, targets and what is known of them lie in rows, a row of the batch in each column.
        """
        z, target, at = o.reshape(4, -1), y.reshape(-1), None
        if not known.all():
            at = np.flatnonzero(known)
            z, target = z[:, at], target[at]
        soft = _softplus(z[1:])
        nu, al, be = soft[0] + 1e-6, soft[1] + (1 + 1e-6), soft[2] + 1e-6
        e = target - z[0]
        lam, size, square, more = self.loss_weight, np.abs(e), e * e, al + 0.5
        om = 2 * be * (1 + nu)
        big = nu * square + om
        log_nu, log_om, log_big = np.log(np.stack([nu, om, big]))
        lgammas, digammas = _gammas(np.stack([al, more]))
        wide = lam * size * (2 * nu + al)
        loss = 0.5 * (math.log(math.pi) - log_nu) - al * log_om + more * log_big + lgammas[0] - lgammas[1] + wide
        per = more / big
        found = np.empty_like(z)
        found[0] = -2 * per * nu * e - lam * np.sign(e) * (2 * nu + al)
        found[1] = -0.5 / nu - al / (1 + nu) + per * (square + 2 * be) + 2 * lam * size
        found[2] = log_big - log_om + digammas[0] - digammas[1] + lam * size
        found[3] = -al / be + 2 * per * (1 + nu)
        found[1:] *= -np.expm1(-soft)
        if at is None:
            return float(loss.sum()), found.reshape(o.shape)
        delta = np.zeros((4, o.size // 4))
        delta[:, at] = found
        return float(loss.sum()), delta.reshape(o.shape)


def _softplus(z):
    """``log(1 + exp(z))``; its derivative is ``-expm1(-softplus)``."""
    return np.maximum(z, 0.0) + np.log1p(np.exp(-np.abs(z)))


def _lgamma(x):
    """Log gamma for x > 0: recurrence up to x + 6, then the Stirling series."""
    z = x + 6.0
    inv = 1.0 / z
    inv2 = inv * inv
    series = inv * (1 / 12 - inv2 * (1 / 360 - inv2 * (1 / 1260 - inv2 * (1 / 1680 - inv2 / 1188))))
    product = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - np.log(product)


def _gammas(x):
    """``_lgamma`` and ``_digamma`` of x, which share a logarithm and the product x (x + 1) ... (x + 5).

    With u = x (x + 5) the product is u (u + 4) (u + 6), and the sum of 1 / (x + k) its logarithm's derivative.
    """
    z = x + 6.0
    inv, log = 1.0 / z, np.log(z)
    inv2 = inv * inv
    u = x * (x + 5.0)
    u4, u6 = u + 4.0, u + 6.0
    both = u4 * u6
    series = inv * (1 / 12 - inv2 * (1 / 360 - inv2 * (1 / 1260 - inv2 * (1 / 1680 - inv2 / 1188))))
    lgamma = (z - 0.5) * log - z + 0.5 * math.log(2 * math.pi) + series - np.log(u * both)
    terms = (2.0 * x + 5.0) * (both + u * (u4 + u6)) / (u * both)
    return lgamma, log - 0.5 * inv - inv2 * (1 / 12 - inv2 * (1 / 120 - inv2 / 252)) - terms


# ---- weights as a table ---------------------------------------------------------------

def shards_of(rows: DataFrame, slice_col: str, shard_rows: int) -> DataFrame:
    """(slice, shards): into how many shards of about ``shard_rows`` rows each slice is dealt."""
    counts = rows.groupBy(F.col(slice_col).alias("slice")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("slice", F.ceil(F.col("n") / shard_rows).cast("int").alias("shards"))


def to_shards(weights: DataFrame, shards: DataFrame) -> DataFrame:
    """Each slice's rows of ``weights``, once for each of its shards (slice, shard, ...)."""
    copies = shards.select(
        F.col("slice").alias("_own"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    return weights.join(copies, F.col("slice") == F.col("_own")).drop("_own")


def vector_of(table, column: str) -> np.ndarray:
    """The vector whose blocks are rows of an Arrow table."""
    blocks = table.sort_by("block")[column].combine_chunks()
    return blocks.flatten().to_numpy(zero_copy_only=False).astype(float)


def block_rows(vector: np.ndarray) -> list[tuple[int, np.ndarray]]:
    return [(b, vector[at:at + BLOCK]) for b, at in enumerate(range(0, len(vector), BLOCK))]


def matrix_of(columns) -> np.ndarray:
    """Arrow columns of doubles side by side, nulls as NaN."""
    return np.column_stack([np.asarray(c.to_numpy(zero_copy_only=False), dtype=float) for c in columns])


def head_array(head) -> pa.StructArray:
    """A head's four (rows, tasks) arrays as one Arrow column of lists; no value becomes a Python object."""
    lists = []
    for part in head:
        ends = pa.array(np.arange(0, part.size + 1, part.shape[1], dtype=np.int32))
        lists.append(pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(part).reshape(-1))))
    return pa.StructArray.from_arrays(lists, names=_HEAD)


_HEAD = ("gamma", "nu", "alpha", "beta")
_HEADS = T.StructType([T.StructField(c, T.ArrayType(T.DoubleType())) for c in _HEAD])


class EvidentialModel:
    """Fitted networks: the weights of each slice (``""`` when there is only one) as a table.

    ``weights`` has (slice, block, theta); ``history`` (slice, epoch, train_loss, val_loss, val_mse,
    learning_rate); ``variance`` (slice, task, variance) of the training targets.  All are read
    when they are used; nothing of them is held by the driver.
    """

    def __init__(self, network: Network, features: Sequence[str], tasks: Sequence[str], weights: DataFrame,
                 by: str | None = None, history: DataFrame | None = None, variance: DataFrame | None = None):
        self.network, self.features, self.tasks, self.by = network, list(features), list(tasks), by
        self.weights, self.history, self.variance = weights, history, variance

    @classmethod
    def of_vector(cls, spark: SparkSession, network: Network, features: Sequence[str], tasks: Sequence[str],
                  vector: np.ndarray) -> EvidentialModel:
        """A model of one network with known weights."""
        rows = [("", b, part.tolist()) for b, part in block_rows(vector)]
        return cls(network, features, tasks, spark.createDataFrame(rows, "slice string, block int, theta array<double>"))

    def vector(self, name: str = "") -> np.ndarray:
        """The weights of one slice."""
        return vector_of(self.weights.where(F.col("slice") == name).select("block", "theta").toArrow(), "theta")

    def weights_table(self) -> DataFrame:
        """(slice, layer, kind, pos, value): one row per weight."""
        flat = self.weights.select("slice", "block", F.posexplode("theta").alias("i", "value")).select(
            "slice", (F.col("block") * BLOCK + F.col("i")).cast("long").alias("at"), "value")
        layer, kind, pos, at = F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(None).cast("long"), 0
        for number, (i, o) in enumerate(self.network.shapes):
            for name, size in (("kernel", i * o), ("bias", o)):
                here = (F.col("at") >= at) & (F.col("at") < at + size)
                layer = F.when(here, number).otherwise(layer)
                kind = F.when(here, name).otherwise(kind)
                pos = F.when(here, F.col("at") - at).otherwise(pos)
                at += size
        return flat.select("slice", layer.alias("layer"), kind.alias("kind"), pos.alias("pos"), "value")

    def score(self, table: DataFrame) -> DataFrame:
        """Adds raw outputs and ``mu, alea, epis``; all other columns pass through.

        Rows with a missing feature, or of a slice without a model, get NULLs.  With several
        tasks each row becomes one row per task, named in ``task``.  One network goes to all tasks;
        of several, each shard of a slice's rows gets its own slice's only.
        """
        raw = self._score_one(table) if self.by is None else self._score_slices(table)
        if len(self.tasks) > 1:
            names = F.array(*[F.lit(t) for t in self.tasks])
            zipped = F.arrays_zip(names.alias("task"), *[F.col(f"_p.{c}").alias(c) for c in _HEAD])
            raw = raw.select(*table.columns, F.inline(zipped).alias("task", *_HEAD))
        else:
            raw = raw.select(*table.columns, *[F.element_at(f"_p.{c}", 1).alias(c) for c in _HEAD])
        return evidential_head(nan_to_null(raw, list(_HEAD)))

    def _score_one(self, table: DataFrame) -> DataFrame:
        """Only the features leave the JVM; the one vector's size is that of the network."""
        network = self.network
        shared = table.sparkSession.sparkContext.broadcast(self.vector())

        @F.arrow_udf(_HEADS)
        def predict(x: pa.Array) -> pa.Array:
            return head_array(network.outputs(shared.value, matrix_of(x.flatten())))

        return table.withColumn("_p", predict(F.struct(*[F.col(f).cast("double").alias(f) for f in self.features])))

    def _score_slices(self, table: DataFrame) -> DataFrame:
        network, features = self.network, [f"_f{i}" for i in range(len(self.features))]
        rows = table.withColumns({
            "_slice": F.col(self.by).cast("string"),
            **{f: F.col(c).cast("double") for f, c in zip(features, self.features)}})
        shards = stored(shards_of(rows, "_slice", SHARD_ROWS), "shards")
        own = shards.withColumnsRenamed({"slice": "_slice", "shards": "_shards"})
        rows = join_on_keys(rows, own, ["_slice"], "inner").withColumn(
            "_shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_shards")).cast("int")).drop("_shards")
        messages = to_shards(self.weights, shards).select("slice", "shard", "block", "theta")
        columns = table.columns

        def predict(part, weights):
            x = matrix_of([part[f] for f in features])
            if weights.num_rows:
                head = network.outputs(vector_of(weights, "theta"), x)
            else:
                head = [np.full((len(x), network.n_tasks), math.nan)] * 4
            return part.select(columns).append_column("_p", head_array(head))

        return rows.groupBy("_slice", "_shard").cogroup(messages.groupBy("slice", "shard")).applyInArrow(
            predict, T.StructType([*table.schema.fields, T.StructField("_p", _HEADS)]))

    def save(self, path: str) -> None:
        """Weights, history and variance as Parquet tables, the settings as one JSON row."""
        spark = self.weights.sparkSession
        self.weights.write.mode("overwrite").parquet(f"{path}/weights")
        for name, table in (("history", self.history), ("variance", self.variance)):
            if table is not None:
                table.write.mode("overwrite").parquet(f"{path}/{name}")
        settings = json.dumps({
            "network": asdict(self.network), "features": self.features, "tasks": self.tasks, "by": self.by,
            "tables": [n for n in ("history", "variance") if getattr(self, n) is not None]})
        spark.createDataFrame([(settings,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> EvidentialModel:
        """The model that ``save`` wrote; its tables are read where they are used."""
        settings = json.loads(spark.read.text(f"{path}/settings", wholetext=True).first()[0])
        tables = {name: spark.read.parquet(f"{path}/{name}") for name in settings["tables"]}
        return cls(Network(**settings["network"]), settings["features"], settings["tasks"],
                   spark.read.parquet(f"{path}/weights"), settings["by"], **tables)
