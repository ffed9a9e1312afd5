"""Scores, histograms, curves and tests of predictions.

A prediction table has ``truth``, ``mu`` and the variances ``alea`` and ``epis``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopanel.cluster import join_on_keys, small_side, stored
from canopanel.functions.special import normal_cdf
from canopanel.operators.ranking import bracket_at, exact_quantiles, rank_blocks, sketch_around

Z95 = 1.96


def regression_metrics(pred: DataFrame, keys: Sequence[str] = (), truth: str = "truth",
                       mu: str = "mu") -> DataFrame:
    """R2, MSE, RMSE, MAE, truth range and row count, overall or per group, in one pass."""
    both = pred.where(F.col(truth).isNotNull() & F.col(mu).isNotNull())
    error = F.col(truth) - F.col(mu)
    mse = F.avg(error * error)
    return both.groupBy(*keys).agg(
        (1 - F.try_divide(mse, F.var_pop(truth))).alias("r2"), mse.alias("mse"),
        F.sqrt(mse).alias("rmse"), F.avg(F.abs(error)).alias("mae"),
        F.min(truth).alias("truth_min"), F.max(truth).alias("truth_max"), F.count("*").alias("n"))


def with_errors(pred: DataFrame, truth: str = "truth", mu: str = "mu", alea: str = "alea",
                epis: str = "epis") -> DataFrame:
    """Adds ``abs_error`` and ``total`` uncertainty."""
    return pred.withColumns({
        "abs_error": F.abs(F.col(truth) - F.col(mu)), "total": F.col(alea) + F.col(epis)})


def with_sigma(pred: DataFrame, columns: Sequence[str] = ("alea", "epis")) -> DataFrame:
    """Square roots of variances: ``<c>_sigma``."""
    return pred.withColumns({f"{c}_sigma": F.sqrt(c) for c in columns})


def with_interval(pred: DataFrame, mu: str = "mu", alea: str = "alea", epis: str = "epis",
                  z: float = Z95) -> DataFrame:
    """Interval ``mu -+ z * sqrt(alea + epis)``: ``lower`` and ``upper``."""
    half = z * F.sqrt(F.col(alea) + F.col(epis))
    return pred.withColumns({"lower": F.col(mu) - half, "upper": F.col(mu) + half})


def bias_variance(pred: DataFrame, keys: Sequence[str] = (), truth: str = "truth",
                  mu: str = "mu") -> DataFrame:
    """Mean and population variance of ``mu - truth``."""
    error = F.col(mu) - F.col(truth)
    return pred.groupBy(*keys).agg(F.avg(error).alias("bias"), F.var_pop(error).alias("variance"))


def _bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin 0 .. bins-1 by the edges ``lo + b * width``; the last bin includes its
    upper edge.  The quotient is a first guess, moved by one where rounding misplaced it.

    A single-valued column is spread over one unit, as histogram tools do.
    """
    flat = lo == hi
    lo, hi = F.when(flat, lo - 0.5).otherwise(lo), F.when(flat, hi + 0.5).otherwise(hi)
    width = (hi - lo) / bins
    guess = F.floor((x - lo) / width)
    moved = (guess - (x < lo + guess * width).cast("int")
             + (x >= lo + (guess + 1) * width).cast("int"))
    return F.least(F.lit(bins - 1), moved).cast("int")


def _range_of(table: DataFrame, columns: Sequence[str]) -> Column:
    """Smallest and largest value over all the columns, as a one-row subquery."""
    lo = F.least(*[F.min(c) for c in columns]) if len(columns) > 1 else F.min(columns[0])
    hi = F.greatest(*[F.max(c) for c in columns]) if len(columns) > 1 else F.max(columns[0])
    return table.agg(F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi")).alias("r")).scalar()


def histogram(table: DataFrame, columns: Sequence[str], bins: int) -> DataFrame:
    """Counts on common equal-width bins over the pooled range: (feature, bin, left, right, n).

    Empty bins are listed with n = 0.
    """
    bounds = _range_of(table, columns)
    values = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("_x")) for c in columns])
    counts = (
        table.select(F.inline(values)).where("_x IS NOT NULL").withColumn("_r", bounds)
        .groupBy("feature", _bin(F.col("_x"), F.col("_r.lo"), F.col("_r.hi"), bins).alias("bin"))
        .agg(F.count("*").alias("n")))
    spark = table.sparkSession
    frame = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in columns])).alias("feature")).select(
        "feature", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("_r.hi") - F.col("_r.lo")) / bins
    return (frame.join(counts, ["feature", "bin"], "left").withColumn("_r", bounds).select(
        "feature", "bin", (F.col("_r.lo") + width * F.col("bin")).alias("left"),
        (F.col("_r.lo") + width * (F.col("bin") + 1)).alias("right"),
        F.coalesce("n", F.lit(0)).alias("n")))


def histogram_2d(table: DataFrame, x: str, y: str, bins: int = 50, min_count: int = 7) -> DataFrame:
    """Counts on a bins x bins grid; grid cells with fewer than ``min_count`` rows are left out."""
    both = table.select(F.col(x).alias("_x"), F.col(y).alias("_y")).where("_x IS NOT NULL AND _y IS NOT NULL")
    ranges = both.agg(F.struct(
        F.min("_x").alias("x0"), F.max("_x").alias("x1"), F.min("_y").alias("y0"), F.max("_y").alias("y1")
    ).alias("r")).scalar()
    r = both.withColumn("_r", ranges)
    return (r.groupBy(
        _bin(F.col("_x"), F.col("_r.x0"), F.col("_r.x1"), bins).alias("x_bin"),
        _bin(F.col("_y"), F.col("_r.y0"), F.col("_r.y1"), bins).alias("y_bin"))
        .agg(F.count("*").alias("n")).where(F.col("n") >= min_count))


def gaussian_fit(table: DataFrame, column: str, points: int = 500, bins: int = 50) -> DataFrame:
    """Normal curve with the column's mean and population deviation, scaled to bin counts."""
    moments = table.agg(F.struct(
        F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"),
        F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"),
        F.count(column).alias("n")).alias("m")).scalar()
    grid = table.sparkSession.range(points).withColumn("m", moments).select(
        F.col("id").alias("i"), "m",
        (F.col("m.lo") + (F.col("m.hi") - F.col("m.lo")) * F.col("id") / (points - 1)).alias("x"))
    z = (F.col("x") - F.col("m.mean")) / F.col("m.std")
    density = F.exp(-0.5 * z * z) / (F.col("m.std") * math.sqrt(2 * math.pi))
    return grid.select("i", "x", (density * F.col("m.n") * (F.col("m.hi") - F.col("m.lo")) / bins).alias("y"))


KDE_BINS = 64  # bins in one bandwidth
KDE_REACH = 9  # bandwidths after which the kernel (under 3e-18) is taken as nothing


def kde(table: DataFrame, column: str, points: int = 200) -> DataFrame:
    """Gaussian kernel density with Scott's bandwidth ``h = n^(-1/5) * std`` on even points: (i, x, density).

    Values are counted in bins of ``h / 64`` while they are read, with the first three powers of
    their distance to the bin's middle; the kernel is then expanded around each bin instead of each
    value (a fast Gauss transform).  What the expansion leaves out is under ``3 / 24 * (1 / 128)^4``,
    5e-10 of the kernel's height, for every value.  A shuffle holds bins, not rows.
    """
    moments = table.agg(F.struct(
        F.stddev_samp(column).alias("std"), F.min(column).cast("double").alias("lo"),
        F.max(column).cast("double").alias("hi"), F.count(column).cast("double").alias("n")
    ).alias("m")).scalar()
    h = F.col("m.std") * F.pow(F.col("m.n"), F.lit(-0.2))
    x = F.col(column).cast("double")
    placed = table.where(x.isNotNull()).select(x.alias("_x")).withColumn("m", moments).where(h > 0)
    placed = placed.select("m", h.alias("h"), ((F.col("_x") - F.col("m.lo")) / h * KDE_BINS).alias("_at"))
    bin_ = F.floor("_at").alias("bin")
    t = (F.col("_at") - F.floor("_at") - 0.5) / KDE_BINS
    bins = placed.groupBy(bin_).agg(
        F.count(F.lit(1)).alias("n0"), *[F.sum(t if k == 1 else t * t if k == 2 else t * t * t).alias(f"n{k}") for k in (1, 2, 3)],
        F.first("m").alias("m"), F.first("h").alias("h"))
    # Points that a bin reaches, and how many bandwidths they lie behind its middle.
    width = (F.col("m.hi") - F.col("m.lo")) / (points - 1) / F.col("h")
    middle = (F.col("bin") + 0.5) / KDE_BINS
    first = F.greatest(F.lit(0), F.ceil((middle - KDE_REACH) / width)).cast("int")
    last = F.least(F.lit(points - 1), F.floor((middle + KDE_REACH) / width)).cast("int")
    met = bins.where(first <= last).select("*", F.explode(F.sequence(first, last)).alias("i"), middle.alias("_c"), width.alias("_w"))
    met = met.withColumn("u", F.col("i") * F.col("_w") - F.col("_c"))
    u = F.col("u")
    part = F.exp(-0.5 * u * u) * (
        F.col("n0") + u * F.col("n1") + (u * u - 1) / 2 * F.col("n2") + (u * u - 3) * u / 6 * F.col("n3"))
    sums = met.groupBy("i").agg(F.sum(part).alias("s"))
    frame = table.sparkSession.range(points).select(F.col("id").cast("int").alias("i"))
    both = frame.join(sums, "i", "left").withColumn("m", moments).withColumn("h", h)
    return both.select(
        F.col("i").cast("long").alias("i"),
        (F.col("m.lo") + (F.col("m.hi") - F.col("m.lo")) * F.col("i") / (points - 1)).alias("x"),
        F.when(F.col("h") > 0, F.coalesce("s", F.lit(0.0)) / (F.col("m.n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"))


def corr_matrix(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlations as (a, b, r) rows, all pairs in one pass."""
    pairs = list(combinations_with_replacement(columns, 2))
    one = table.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = []
    for i, (a, b) in enumerate(pairs):
        for p, q in {(a, b), (b, a)}:
            rows.append(F.struct(F.lit(p).alias("a"), F.lit(q).alias("b"), F.col(f"r{i}").alias("r")))
    return one.select(F.inline(F.array(*rows)))


def discard_test(pred: DataFrame, measures: Sequence[str], keys: Sequence[str],
                 slice_cols: Sequence[str] = (), truth: str = "truth", mu: str = "mu",
                 steps: int = 11, parts: int = 20) -> DataFrame:
    """RMSE after dropping the ``i / parts`` most uncertain rows, i = 0 .. steps-1.

    Result: (slice_cols, measure, i, kept, rmse).  Ties in a measure are ordered by
    ``keys``, which must be unique.  Rows with a missing measure or error are left out.

    A sketch brackets every cut.  Rows between brackets are summed where they are, rows inside one by
    their value, so ties become one entry before anything is moved.  Values that a cut falls into are
    opened key by key: among rows of the value a sketch brackets the first key, rows with a key in
    the bracket are counted and summed by it, those of the key that the cut falls into by the next,
    and so on.  No row is sorted, and what is shuffled are sums.
    """
    by = [*slice_cols, "measure"]
    error = F.col(truth) - F.col(mu)
    rows = stored(pred.select(*slice_cols, *keys, *measures, (error * error).alias("_sq")).where("_sq IS NOT NULL"), "discard")
    long = rows.select(*slice_cols, *keys, "_sq", F.inline(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("_u")) for m in measures]))).where("_u IS NOT NULL")
    known = sketch_around(long, by, "_u", [(parts - i) / parts for i in range(1, steps)])
    values = _values_at_cuts(long, known, by, steps - 1)
    cuts = _cuts(values, by, steps, parts)
    done = cuts.where("_need = 0").select(*by, "i", "_kept", "_below")
    for depth, key in enumerate(keys):
        prefix = ["_u", *keys[:depth]]
        cuts = _opened(long, cuts.where("_need > 0"), by, prefix, key)
        done = done.unionByName(cuts.where("_need = 0").select(*by, "i", "_kept", "_below"))
    return done.select(*by, "i", F.col("_kept").alias("kept"), F.sqrt(F.col("_below") / F.col("_kept")).alias("rmse"))


def _values_at_cuts(long: DataFrame, known: DataFrame, by: list[str], cuts: int) -> DataFrame:
    """(by, _u, _n, _sq, _open): each value inside a bracket, and all rows between two brackets as one.

    The brackets descend.  A row is surely below some of them and perhaps below more; where both
    numbers are equal no cut can fall on it.
    """
    u = F.col("_u")
    surely = sum((u < F.col("_q")[2 * i]).cast("int") for i in range(cuts))
    perhaps = sum((u <= F.col("_q")[2 * i + 1]).cast("int") for i in range(cuts))
    tagged = join_on_keys(long, known, by, "inner").select(*by, "_u", "_sq", surely.alias("_above"), perhaps.alias("_segment"))
    inside = F.col("_above") < F.col("_segment")
    tagged = tagged.withColumn("_value", F.when(inside, u))
    return tagged.groupBy(*by, "_segment", "_value").agg(
        F.min("_u").alias("_u"), F.count(F.lit(1)).alias("_n"), F.sum("_sq").alias("_sq")).drop("_segment", "_value")


def _cuts(values: DataFrame, by: list[str], steps: int, parts: int) -> DataFrame:
    """(by, i, _kept, _u, _need, _below): the value each cut falls into, and what lies below it.

    ``_below`` is the squared error of all values below; ``_need`` rows of the value itself are kept.
    """
    rows, blocks = rank_blocks(values, by, ["_u"], "_n", ["_sq"])
    group = Window.partitionBy(*by)
    blocks = blocks.withColumn("_sq_before", F.coalesce(F.sum("_sq").over(
        group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    within = Window.partitionBy(*by, "_part").orderBy("_u").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = join_on_keys(rows, blocks.select(*by, "_part", "_before", "_total", "_sq_before"), [*by, "_part"], "inner").withColumns({
        "_to": F.col("_before") + F.sum("_n").over(within), "_through": F.col("_sq_before") + F.sum("_sq").over(within)})
    kept = F.array(*[
        F.struct(F.lit(i).cast("long").alias("i"), F.expr(f"_total - ({i} * _total) div {parts}").alias("_kept")) for i in range(steps)])
    cut = placed.select(*by, "_u", "_n", "_sq", "_to", "_through", F.inline(kept)).where("_to - _n < _kept AND _kept <= _to")
    whole = F.col("_kept") == F.col("_to")
    return stored(cut.select(
        *by, "i", "_kept", "_u", F.when(whole, 0).otherwise(F.col("_kept") - F.col("_to") + F.col("_n")).cast("long").alias("_need"),
        F.when(whole, F.col("_through")).otherwise(F.col("_through") - F.col("_sq")).alias("_below")), "cuts")


def _opened(long: DataFrame, cuts: DataFrame, by: list[str], prefix: list[str], key: str) -> DataFrame:
    """The cuts with the label of ``key`` that each falls into, among the rows equal to it so far.

    Labels are bracketed by a sketch of each prefix; below a bracket rows are only summed.  Labels of
    a type without a sketch (strings) are all counted.
    """
    mine = small_side(cuts.select(*by, *prefix, "i", "_kept", "_need", "_below"))
    group = [*by, *prefix]
    tied = join_on_keys(long.select(*group, key, "_sq"), mine.select(*group).distinct(), group, "inner")
    label = F.col(key)
    if isinstance(long.schema[key].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        bracketed = bracket_at(tied, mine, group, key, F.col("_need"))
        low = label < F.col("_from")
    else:
        bracketed, low = mine.withColumns({"_from": F.lit(None).cast("string"), "_to": F.lit(None).cast("string")}), F.lit(False)
    met = join_on_keys(long.select(*group, key, "_sq"), bracketed, group, "inner").where(F.col("_to").isNull() | (label <= F.col("_to")))
    settled = F.coalesce(low, F.lit(False))
    labels = met.groupBy(*group, "i", "_kept", "_need", "_below", settled.alias("_low"), F.when(~settled, label).alias(key)).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_sq").alias("_here"))
    along = Window.partitionBy(*by, "i").orderBy(F.desc("_low"), key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = labels.withColumns({"_to": F.sum("_n").over(along), "_through": F.sum("_here").over(along)})
    whole = F.col("_need") == F.col("_to")
    return stored(placed.where("_to - _n < _need AND _need <= _to").select(
        *group, key, "i", "_kept", F.when(whole, 0).otherwise(F.col("_need") - F.col("_to") + F.col("_n")).cast("long").alias("_need"),
        (F.col("_below") + F.col("_through") - F.when(whole, 0.0).otherwise(F.col("_here"))).alias("_below")), "cuts")


def iqr_outliers(table: DataFrame, column: str, factor: float = 1.5) -> DataFrame:
    """Rows outside ``[Q1 - factor*IQR, Q3 + factor*IQR]``, with the fences."""
    q = exact_quantiles(table, [column], 4, [1, 3]).groupBy().agg(
        F.max(F.when(F.col("k") == 1, F.col("quantile"))).alias("q1"),
        F.max(F.when(F.col("k") == 3, F.col("quantile"))).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    fences = q.select(F.struct((F.col("q1") - factor * iqr).alias("lo"),
                               (F.col("q3") + factor * iqr).alias("hi"))).scalar()
    return (table.withColumn("_f", fences).withColumns({"lower_fence": F.col("_f.lo"), "upper_fence": F.col("_f.hi")})
            .where((F.col(column) < F.col("lower_fence")) | (F.col(column) > F.col("upper_fence"))).drop("_f"))


def pit_flag(pred: DataFrame, truth: str = "truth", mu: str = "mu", out: str = "pit_flag") -> DataFrame:
    """1.0 where the prediction does not exceed the truth, else 0.0."""
    return pred.withColumn(out, (F.col(mu) <= F.col(truth)).cast("double"))


def _standardised(pred: DataFrame, truth: str = "truth", mu: str = "mu", alea: str = "alea", epis: str = "epis") -> DataFrame:
    """Adds the standardised error ``_z``; a column of its own, so that no expression repeats it."""
    sigma = F.sqrt(F.col(alea) + F.col(epis))
    return pred.withColumn("_z", F.when(sigma > 0, (F.col(truth) - F.col(mu)) / sigma))


def pit(pred: DataFrame, truth: str = "truth", mu: str = "mu", alea: str = "alea",
        epis: str = "epis", out: str = "pit") -> DataFrame:
    """Probability integral transform: normal CDF of the standardised error.

    Rows without any predicted variance get NULL.
    """
    return _standardised(pred, truth, mu, alea, epis).withColumn(out, normal_cdf("_z")).drop("_z")


def pit_histogram(pred: DataFrame, bins: int = 20, **columns: str) -> DataFrame:
    """Density of the PIT on [0, 1]: (bin, n, density); 1 everywhere when calibrated."""
    values = _standardised(pred, **columns).where("_z IS NOT NULL").select(normal_cdf("_z").alias("_pit"))
    counts = values.groupBy(_bin(F.col("_pit"), F.lit(0.0), F.lit(1.0), bins).alias("bin")).agg(
        F.count("*").alias("n"))
    frame = pred.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    full = frame.join(small_side(counts), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    everything = Window.partitionBy(F.lit(0))
    return full.withColumn("density", F.col("n") * bins / F.sum("n").over(everything))


def slice_compare(pred: DataFrame, slice_col: str, slices: Sequence, truth: str = "truth",
                  mu: str = "mu") -> DataFrame:
    """Truth and emulator means side by side, one column per slice: (source, <slice>...)."""
    pairs = F.array(F.struct(F.lit("truth").alias("source"), F.col(truth).alias("_v")),
                    F.struct(F.lit("emulator").alias("source"), F.col(mu).alias("_v")))
    return pred.select(slice_col, F.inline(pairs)).groupBy("source").pivot(slice_col, list(slices)).agg(F.avg("_v"))


def slice_uncertainty(pred: DataFrame, keys: Sequence[str], measures: Sequence[str] = ("alea", "epis")) -> DataFrame:
    """Mean of each measure per slice, in long form: (keys, measure, mean)."""
    means = pred.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in measures])
    return means.unpivot(list(keys), list(measures), "measure", "mean")
