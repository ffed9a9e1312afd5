"""Variance-based sensitivity (extended FAST).

Cukier et al. 1973; Saltelli, Tarantola & Chan 1999.  Each parameter has its own search
curve of ``n_samples`` points on which it oscillates fast and all others slowly.  The number
of points is a setting of the method and does not grow with the data.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopanel.cluster import join_on_keys

BLOCK = 1 << 16  # points of a curve that one group transforms


def frequencies(n_params: int, n_samples: int, harmonics: int = 4) -> tuple[int, list[int]]:
    """Frequency of a curve's own parameter, and those of the others in order."""
    if n_samples <= 4 * harmonics ** 2:
        raise ValueError(f"n_samples must be over {4 * harmonics ** 2}")
    own = (n_samples - 1) // (2 * harmonics)
    highest, others = own // (2 * harmonics), n_params - 1
    if highest >= others:
        return own, [int(f) for f in np.floor(np.linspace(1, highest, others))]
    return own, [i % highest + 1 for i in range(others)]


def phases(n_params: int, seed: int) -> list[float]:
    """One phase per curve, in turns [0, 1)."""
    rng = random.Random(seed)
    return [rng.random() for _ in range(n_params)]


def fast_sample(
    spark: SparkSession,
    bounds: DataFrame | Sequence[tuple[str, float, float]],
    n_samples: int,
    harmonics: int = 4,
    seed: int = 0,
) -> DataFrame:
    """Sample points (curve, n, <parameter>...): one row per point of each curve.

    ``bounds`` holds (name, lo, hi).  The search curve ``1/2 + asin(sin t) / pi`` is a
    triangle wave, computed here without trigonometry from whole turns.
    """
    if isinstance(bounds, DataFrame):
        bounds = [(r["name"], r["lo"], r["hi"]) for r in bounds.select("name", "lo", "hi").orderBy("name").collect()]
    names = [b[0] for b in bounds]
    own, others = frequencies(len(names), n_samples, harmonics)
    shift = phases(len(names), seed)
    points = spark.range(len(names) * n_samples).select(
        F.expr(f"cast(id div {n_samples} as int)").alias("_i"), (F.col("id") % n_samples).alias("n"))
    pick = F.col("_i") + 1
    phase = F.element_at(F.array(*[F.lit(p) for p in shift]), pick)
    columns = []
    for j, (name, lo, hi) in enumerate(bounds):
        # The other parameters take the slow frequencies in order, skipping the curve's own.
        omega = [own if i == j else others[j if j < i else j - 1] for i in range(len(names))]
        speed = F.element_at(F.array(*[F.lit(w).cast("long") for w in omega]), pick)
        turns = (speed * F.col("n")) % n_samples / F.lit(float(n_samples)) + phase + 0.25
        wave = 1.0 - F.abs(2.0 * (turns - F.floor(turns)) - 1.0)
        columns.append((F.lit(float(lo)) + F.lit(float(hi) - float(lo)) * wave).alias(name))
    curve = F.element_at(F.array(*[F.lit(n) for n in names]), pick).alias("curve")
    return points.select(curve, "n", *columns)


def fast_first_order(outputs: DataFrame, n_samples: int, harmonics: int = 4, value: str = "y",
                     by: Sequence[str] = ()) -> DataFrame:
    """First-order indices (by, name, S1) from plain sums over each curve's harmonics."""
    own = (n_samples - 1) // (2 * harmonics)
    y, n = F.col(value), F.col("n")
    aggs = [F.var_pop(y).alias("_v"), F.sum(y * (1 - 2 * (n % 2))).alias("_nyquist")]
    for p in range(1, harmonics + 1):
        angle = (F.lit(p * own).cast("long") * n) % n_samples * (2 * math.pi / n_samples)
        aggs += [F.sum(y * F.cos(angle)).alias(f"_c{p}"), F.sum(y * F.sin(angle)).alias(f"_s{p}")]
    sums = outputs.groupBy(*by, F.col("curve").alias("name")).agg(*aggs)
    power = sum(F.col(f"_c{p}") ** 2 + F.col(f"_s{p}") ** 2 for p in range(1, harmonics + 1))
    # The spectrum's total leaves out the single highest term that even lengths have.
    total = F.col("_v") * float(n_samples) ** 2
    if n_samples % 2 == 0:
        total = total - F.col("_nyquist") ** 2
    return sums.select(*by, "name", F.try_divide(2 * power, total).alias("S1"))


def partial_spectrum(y: np.ndarray, at: np.ndarray, n: int, terms: int) -> np.ndarray:
    """``sum(y * exp(-2 pi i k at / n))`` for k = 1 .. terms, of points ``at`` of a curve of ``n``.

    ``y`` may hold several rows of values at the same points.  A chirp-z transform: three FFTs of
    the size of the block and the terms, whatever ``n`` is.
    """
    first, length = int(at.min()), int(at.max() - at.min()) + 1
    values = np.zeros((*y.shape[:-1], length))
    values[..., at - first] = y

    def chirp(m: np.ndarray) -> np.ndarray:
        return np.exp(-1j * np.pi * ((m.astype(object) ** 2) % (2 * n)).astype(float) / n)

    k, j = np.arange(terms + 1), np.arange(length)
    size = 1 << (length + terms).bit_length()
    a = np.fft.fft(values * chirp(j), size)
    kernel = np.zeros(size, dtype=complex)
    kernel[:terms + 1] = chirp(k).conj()
    kernel[size - length + 1:] = chirp(j[1:]).conj()[::-1]
    sums = np.fft.ifft(a * np.fft.fft(kernel))[..., :terms + 1] * chirp(k)
    turns = (k.astype(object) * first % n).astype(float) / n
    return (sums * np.exp(-2j * np.pi * turns))[..., 1:]


# Fixed values of the draw: a prime, factors, and cumulative Poisson probabilities at mean 1.
PRIME = (1 << 31) - 1
FACTORS = (48_271, 69_621, 16_807, 12_345)
POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(13)]


def draw_weights(resample: np.ndarray, point: np.ndarray, seed: int = 0) -> np.ndarray:
    """Poisson(1) weights of each point in each resample, inverted from a hash of the two (and the seed).

    The hash stays under 2^62, so any engine with 64-bit integers repeats it.
    """
    a, b, c, d = FACTORS
    x = (point[None, :] % PRIME * a + resample[:, None] * b + seed * c + d) % PRIME
    for step in (1, 2):
        square = x * x % PRIME
        x = (square * square % PRIME * x + step) % PRIME
    return np.searchsorted(np.array(POISSON), x / PRIME, side="right")


def draw_weights_sql(resample: str, point: str, seed: int = 0) -> tuple[str, str, str]:
    """The same in SQL: the first hash, the next one from ``x``, and the weight from the last ``x``."""
    a, b, c, d = FACTORS
    first = f"(({point}) % {PRIME} * {a} + ({resample}) * {b} + {seed * c + d}) % {PRIME}"
    again = f"((x * x % {PRIME}) * (x * x % {PRIME}) % {PRIME} * x + {{step}}) % {PRIME}"
    return first, again, " + ".join(f"(x / {PRIME}.0::DOUBLE >= {p!r}::DOUBLE)::INTEGER" for p in POISSON)


def fast_indices(
    outputs: DataFrame,
    harmonics: int = 4,
    value: str = "y",
    by: Sequence[str] = (),
    n_bootstrap: int = 0,
    conf_level: float = 0.95,
    seed: int = 0,
    chunks: int = 16,
    n_samples: int | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """(by, name, S1, ST, S1_conf, ST_conf) for outputs on the sample's curves.

    A curve is transformed in blocks of points; the blocks' Fourier sums of the low terms and
    the harmonics add up to the curve's.  ``n_samples``, the points of a curve, is counted when
    not given.  Confidence is the normal quantile times the deviation over ``n_bootstrap``
    Poisson resamples: a point's weight in each is inverted from a hash of both, so weighted
    Fourier sums of blocks add up as well, no task holds a curve, and a repeated task draws the
    same.  The resamples of a block are spread over ``chunks`` tasks.
    """
    keys = [*by, "curve"]
    schema = T.StructType([outputs.schema[k] for k in keys])
    number = T.DoubleType()
    values = outputs.select(*keys, F.col("n").cast("long").alias("n"), F.col(value).cast("double").alias(value))
    if n_samples is None:
        n_samples = (values.agg(F.max("n")).first()[0] or 0) + 1
    n = n_samples
    own = (n - 1) // (2 * harmonics)
    low = own // 2

    def transformed(group: pd.DataFrame) -> pd.DataFrame:
        y, at = group[value].to_numpy(float), group["n"].to_numpy()
        sums = np.concatenate([
            partial_spectrum(y, at, n, low),
            [(y * np.exp(-2j * np.pi * (p * own * at % n) / n)).sum() for p in range(1, harmonics + 1)]])
        terms = np.concatenate([np.arange(1, low + 1), np.arange(1, harmonics + 1) * own])
        _, once = np.unique(terms, return_index=True)
        out = group[keys].head(1)
        out = out.loc[out.index.repeat(len(once))].reset_index(drop=True)
        return out.assign(k=terms[once], re=sums[once].real, im=sums[once].imag)

    spectrum = values.groupBy(*keys, F.floor(F.col("n") / block).alias("_block")).applyInPandas(
        transformed, T.StructType([*schema.fields, T.StructField("k", T.LongType()), T.StructField("re", number), T.StructField("im", number)]))
    power = spectrum.groupBy(*keys, "k").agg((F.sum("re") ** 2 + F.sum("im") ** 2).alias("p"))
    harmonic = F.col("k").isin([p * own for p in range(1, harmonics + 1)])
    parts = power.groupBy(*keys).agg(
        F.sum(F.when(harmonic, F.col("p")).otherwise(0.0)).alias("_own"),
        F.sum(F.when(F.col("k") <= low, F.col("p")).otherwise(0.0)).alias("_low"))
    # Half of the spectrum's total; it leaves out the single highest term that even lengths have.
    y = F.col(value)
    total = F.var_pop(y) * float(n) ** 2
    if n % 2 == 0:
        total = total - F.sum(y * (1 - 2 * (F.col("n") % 2))) ** 2
    totals = values.groupBy(*keys).agg((total / 2).alias("_total"))
    estimates = parts.join(totals, keys).select(
        *keys, F.try_divide("_own", "_total").alias("S1"), (1 - F.try_divide("_low", "_total")).alias("ST"))
    if n_bootstrap:
        spread = _bootstrap(values, keys, value, n, harmonics, n_bootstrap, seed, chunks, block)
        z = NormalDist().inv_cdf(0.5 + conf_level / 2)
        estimates = estimates.join(spread.groupBy(*keys).agg(
            (z * F.stddev_samp("_s")).alias("S1_conf"), (z * F.stddev_samp("_t")).alias("ST_conf")), keys)
    else:
        estimates = estimates.withColumns({
            "S1_conf": F.lit(None).cast(number), "ST_conf": F.lit(None).cast(number)})
    return estimates.withColumnRenamed("curve", "name")


def _bootstrap(values: DataFrame, keys: list[str], value: str, n: int, harmonics: int, resamples: int, seed: int,
               chunks: int, block: int) -> DataFrame:
    """(keys, resample, _s, _t): both indices of each weighted curve.

    With weights w and y centred on the curve's plain mean, a resample's spectrum is that of w * y
    and its total sum(w) * sum(w y^2) - sum(w y)^2.
    """
    own = (n - 1) // (2 * harmonics)
    low = own // 2
    means = values.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    centred = join_on_keys(values, means, keys, "inner").withColumns({
        "_y": F.col(value) - F.col("_mean"), "_block": F.floor(F.col("n") / block),
        "_chunk": F.explode(F.sequence(F.lit(0), F.lit(min(chunks, resamples) - 1)))}).select(*keys, "n", "_y", "_block", "_chunk")

    def weighted(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("n")
        y, at = group["_y"].to_numpy(float), group["n"].to_numpy()
        drawn = np.arange(int(group["_chunk"].iloc[0]), resamples, min(chunks, resamples))
        rows = []
        for part in np.array_split(drawn, max(1, len(drawn) * len(at) >> 18)):  # a few megabytes at once
            w = draw_weights(part, at, seed).astype(float)
            sums = [partial_spectrum(w * y, at, n, low)] if low else []
            sums.append(np.stack([(w * y) @ np.exp(-2j * np.pi * (p * own * at % n) / n) for p in range(1, harmonics + 1)], axis=1))
            sums = np.concatenate(sums, axis=1)
            moments = np.stack([w.sum(axis=1), w @ y, w @ (y * y)], axis=1)
            rows += [(r, np.concatenate([m, f.real, f.imag])) for r, m, f in zip(part, moments, sums)]
        out = group[keys].head(1)
        out = out.loc[out.index.repeat(len(rows))].reset_index(drop=True)
        return out.assign(resample=[r for r, _ in rows], sums=[v for _, v in rows])

    fields = [values.schema[k] for k in keys]
    parts = centred.groupBy(*keys, "_block", "_chunk").applyInPandas(weighted, T.StructType(
        [*fields, T.StructField("resample", T.LongType()), T.StructField("sums", T.ArrayType(T.DoubleType()))]))
    added = parts.groupBy(*keys, "resample").agg(
        vector_to_array(Summarizer.sum(array_to_vector(F.col("sums")))).alias("v"))
    power = lambda first, many: F.aggregate(  # noqa: E731  sum of squares of a run of sums
        F.slice("v", first, many), F.lit(0.0), lambda total, x: total + x * x)
    terms = low + harmonics
    own_power = power(4 + low, harmonics) + power(4 + terms + low, harmonics)
    low_power = power(4, low) + power(4 + terms, low) if low else F.lit(0.0)
    total = F.col("v")[0] * F.col("v")[2] - F.col("v")[1] * F.col("v")[1]
    return added.select(*keys, "resample", F.try_divide(2 * own_power, total).alias("_s"),
                        (1 - F.try_divide(2 * low_power, total)).alias("_t"))


def rank_indices(sens: DataFrame, by: Sequence[str] = (), order: str = "S1") -> DataFrame:
    """Adds ``interactions = ST - S1`` and the rank by one index, largest first."""
    window = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return sens.withColumns({
        "interactions": F.col("ST") - F.col("S1"),
        "rank": F.row_number().over(window.orderBy(F.desc(order), "name"))})


def top_indices(sens: DataFrame, k: int = 4, by: Sequence[str] = (), order: str = "ST") -> DataFrame:
    """The ``k`` most influential parameters per group."""
    return rank_indices(sens, by, order).where(F.col("rank") <= k)
