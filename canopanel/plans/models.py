"""Queries on sample tables, evidential models and sensitivity analysis."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopanel.cluster import shared_folder, small_values, stored
from canopanel.functions import calendar as cal
from canopanel.operators import aggregate, evidential, region, reshape, scaling, sensitivity, splits
from canopanel.operators.fitting import fit_evidential as fit
from canopanel.operators.samples import build_samples as samples_of
from canopanel.operators.samples import feature_names
from canopanel.plans import views as v
from canopanel.plans.registry import query, r, rounded
from canopanel.plans.statistics import (
    KEYS, QUANTILE_FIT_SQL, VAL_YEARS, _K, _MEMBERS, _SEASON, fitted_quantiles, member_split, quantile_samples)
from canopanel.plans.tables import _BOX
from canopanel.sources import tables as src

PARAMS = ["p1", "p2", "p3"]


# ---- sample table -------------------------------------------------------------------------

def study_samples(spark: SparkSession, sf: str) -> DataFrame:
    cells = region.box_cells(v.grid(spark, sf), region.CONUS)
    panel = stored(region.select_cells(v.panel(spark, sf), cells), "panel")
    return samples_of(panel, v.params(spark, sf).drop("member_label"), v.forcing_of(panel), cells)


@query("build_samples", f"""
    SELECT p.member, p.time, p.gridcell, {r('value - avg(value) OVER (PARTITION BY p.member, p.gridcell)')} AS target,
           {r('p1')} AS p1, p2, p3, {r('f.tsa')} AS tsa, {r('f.rain + f.snow')} AS precip,
           CAST(year(p.time) AS INTEGER) AS year, CAST(month(p.time) AS INTEGER) AS month,
           {r('sin(2 * pi() * month(p.time) / 12)')} AS m_sin, {r('cos(2 * pi() * month(p.time) / 12)')} AS m_cos
    FROM panel p JOIN params q ON p.member = q.member
         JOIN forcing f ON p.time = f.time AND p.gridcell = f.gridcell
    WHERE p.gridcell IN (SELECT gridcell FROM grid WHERE {_BOX})""", "panel params forcing grid")
def build_samples(spark, sf):
    return rounded(study_samples(spark, sf))


def scaled_samples(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Train and validation samples with features and target scaled on the training rows."""
    features = feature_names(v.params(spark, sf).drop("member_label"))
    samples = splits.split_member_time(study_samples(spark, sf), member_split(spark, sf), VAL_YEARS)
    used = stored(samples.where("split IS NOT NULL"), "samples").withColumns({
        "season": cal.season(F.col("month")), "month_of_year": F.col("month")})
    moments = stored(scaling.fit_standard(used.where("split = 'train'"), [*features, "target"]), "moments")
    scaled = scaling.standard_scale(used, moments, [*features, "target"])
    return scaled.where("split = 'train'"), scaled.where("split = 'val'"), features


# The settings of the study's fits: on yearly, seasonal and monthly samples, and of all cells at once.
ANNUAL = dict(hidden_layers=6, epochs=15, batch_size=1200, loss_weight=0.001, seed=1)
SEASONAL = dict(hidden_layers=4, epochs=18, batch_size=500, loss_weight=0.4, seed=1)
MONTHLY = dict(hidden_layers=3, epochs=18, batch_size=1500, loss_weight=0.1, seed=1)
SPATIAL = dict(hidden_layers=3, epochs=10, batch_size=500, loss_weight=0.01, seed=1)


# ---- evidential -----------------------------------------------------------------------------

@query("evidential_head", f"""
    SELECT {_K}, {r('gamma')} AS mu, {r('beta / (alpha - 1)')} AS alea, {r('beta / (nu * (alpha - 1))')} AS epis
    FROM nig""", "nig")
def evidential_head(spark, sf):
    return rounded(evidential.evidential_head(v.nig(spark, sf)).select(*v.PRED_KEYS, "mu", "alea", "epis"))


_NLL = """0.5 * ln(pi() / nu) - alpha * ln(2 * beta * (1 + nu))
      + (alpha + 0.5) * ln(nu * (y - gamma) ** 2 + 2 * beta * (1 + nu)) + lgamma(alpha) - lgamma(alpha + 0.5)
      + 0.01 * abs(y - gamma) * (2 * nu + alpha)"""


@query("evidential_loss", f"SELECT member, {r(f'avg({_NLL})')} AS loss, count(*) AS n FROM nig GROUP BY 1", "nig")
def evidential_loss(spark, sf):
    return rounded(evidential.evidential_loss(v.nig(spark, sf), ["member"], 0.01))


_SCORED = evidential.Network(n_features=3)  # four layers of 64, the usual size
_SCORE_FEATURES = ["a", "b", "c"]


def _score_sql() -> str:
    """The network written out, one view per layer."""
    layers, inputs, views = _SCORED.layers(_SCORED.initial(1)), list(_SCORE_FEATURES), []
    for i, (w, _) in enumerate(layers):
        sums = [" + ".join(f"{float(x)!r}::DOUBLE * {c}" for x, c in zip(w[:, j], inputs)) for j in range(w.shape[1])]
        views.append(f"sums{i} AS (SELECT member, time, gridcell, "
                     + ", ".join(f"{z} AS z{j}" for j, z in enumerate(sums)) + f" FROM layer{i})")
        if i < len(layers) - 1:
            inputs = [f"h{j}" for j in range(w.shape[1])]
            views.append(f"layer{i + 1} AS (SELECT member, time, gridcell, " + ", ".join(
                f"CASE WHEN z{j} > 0 THEN z{j} ELSE 0.2::DOUBLE * z{j} END AS h{j}" for j in range(w.shape[1])) + f" FROM sums{i})")
    soft = [f"(ln(1 + exp(z{k})) + 1e-6::DOUBLE)" for k in range(4)]
    joined = ",\n    ".join(views)
    return f"""
    WITH layer0 AS (SELECT member, time, gridcell, value / 50 AS a, rain * 10 AS b, snow * 10 AS c FROM panel),
    {joined}
    SELECT member, time, gridcell, {r('z0')} AS mu, {r(f'{soft[3]} / {soft[2]}')} AS alea,
           {r(f'{soft[3]} / ({soft[1]} * {soft[2]})')} AS epis FROM sums{len(layers) - 1}"""


def _scored_model(spark: SparkSession) -> evidential.EvidentialModel:
    return evidential.EvidentialModel.of_vector(spark, _SCORED, _SCORE_FEATURES, ["value"], _SCORED.initial(1))


@query("score", _score_sql(), "panel")
def score(spark, sf):
    """Scoring with fixed weights, so that SQL can repeat it."""
    return rounded(_scored_model(spark).score(_score_inputs(spark, sf)).select(*KEYS, "mu", "alea", "epis"))


def _score_inputs(spark: SparkSession, sf: str) -> DataFrame:
    return v.panel(spark, sf).select(
        *KEYS, (F.col("value") / 50).alias("a"), (F.col("rain") * 10).alias("b"), (F.col("snow") * 10).alias("c"))


@query("fit_evidential")
def fit_evidential(spark, sf):
    train, val, features = scaled_samples(spark, sf)
    model = fit(train, val, features, ["target"], KEYS, **ANNUAL)
    return model.score(train.unionByName(val)).select(*KEYS, "split", "target", "mu", "alea", "epis")


@query("fit_history")
def fit_history(spark, sf):
    train, val, features = scaled_samples(spark, sf)
    return fit(train, val, features, ["target"], KEYS, **ANNUAL).history


@query("fit_by_slice")
def fit_by_slice(spark, sf):
    train, val, features = scaled_samples(spark, sf)
    model = fit(train, val, features, ["target"], KEYS, by="season", **SEASONAL)
    return model.score(train.unionByName(val)).select(*KEYS, "season", "split", "target", "mu", "alea", "epis")


@query("fit_by_month")
def fit_by_month(spark, sf):
    """Twelve networks in one job an epoch, by Adam."""
    train, val, features = scaled_samples(spark, sf)
    model = fit(train, val, features, ["target"], KEYS, by="month_of_year", optimizer="adam", **MONTHLY)
    return model.score(train.unionByName(val)).select(*KEYS, "month_of_year", "split", "target", "mu", "alea", "epis")


@query("fit_multitask")
def fit_multitask(spark, sf):
    """One network for all cells: parameters and month to one output per cell."""
    cells = small_values(v.grid(spark, sf), "gridcell")
    tasks = [f"cell_{c}" for c in cells]
    keys = ["member", "time"]
    wide = splits.split_member_time(
        reshape.stack_multitask(v.panel(spark, sf), cells), member_split(spark, sf), VAL_YEARS)
    table = reshape.with_time_features(reshape.attach_params(
        stored(wide.where("split IS NOT NULL"), "wide"), v.params(spark, sf).drop("member_label")))
    features = [*PARAMS, "m_sin", "m_cos", "year"]
    moments = stored(scaling.fit_standard(table.where("split = 'train'"), [*features, *tasks]), "moments")
    scaled = scaling.standard_scale(table, moments, [*features, *tasks])
    train, val = scaled.where("split = 'train'"), scaled.where("split = 'val'")
    model = fit(train, val, features, tasks, keys, **SPATIAL)
    return model.score(scaled.select(*keys, "split", *features)).select(
        *keys, "split", F.substring("task", 6, 9).cast("int").alias("gridcell"), "mu", "alea", "epis")


# Two steps of whole batches by season, small enough that SQL can repeat every derivative.
_WHOLE = evidential.Network(n_features=3, hidden_layers=1, hidden_neurons=2, l2_weight=0.01, loss_weight=0.1)
_WHOLE_RATE, _WHOLE_STEPS = 0.05, 2


def _digamma_sql(x: str) -> str:
    square = f"(1.0::DOUBLE / (({x} + 6) * ({x} + 6)))"
    series = (f"ln({x} + 6) - 0.5::DOUBLE / ({x} + 6) - {square} * (1.0::DOUBLE / 12 - {square} * (1.0::DOUBLE / 120 - {square} / 252))")
    return f"({series} - {' - '.join(f'1.0::DOUBLE / ({x} + {k})' for k in range(6))})"


def _fit_sql() -> str:
    """The same steps: a view with each row's outputs and derivatives, one with their means, one with new weights."""
    names, kernels, at = [], set(), 0
    for i, o in _WHOLE.shapes:
        kernels |= set(range(at, at + i * o))
        at += (i + 1) * o
    names = [f"t{k}" for k in range(at)]
    hidden, tasks = 2, 4
    first_bias, second, second_bias = 6, 8, 16
    start = ", ".join(f"{float(x)!r}::DOUBLE AS {n}" for n, x in zip(names, _WHOLE.initial(1)))
    lam, l2, rate = _WHOLE.loss_weight, _WHOLE.l2_weight, _WHOLE_RATE
    views = [f"""
    inputs AS (
      SELECT {_SEASON.format(t='time')} AS slice, year(time) IN (2000, 2001) AS held, value / 50 AS x0, rain * 10 AS x1, snow * 10 AS x2,
             value / 25 AS y FROM panel),
    weights0 AS (SELECT DISTINCT slice, {start}, {', '.join(f'0.0::DOUBLE AS v{k}' for k in range(at))} FROM inputs WHERE NOT held)"""]
    for step in range(_WHOLE_STEPS + 1):
        z = [" + ".join([f"t{j + hidden * i} * x{i}" for i in range(3)] + [f"t{first_bias + j}"]) for j in range(hidden)]
        o = [" + ".join([f"t{second + k + tasks * j} * h{j}" for j in range(hidden)] + [f"t{second_bias + k}"]) for k in range(tasks)]
        views.append(f"""
    hidden{step} AS (SELECT *, {', '.join(f'{e} AS z{j}' for j, e in enumerate(z))} FROM inputs JOIN weights{step} USING (slice)),
    active{step} AS (SELECT *, {', '.join(f'CASE WHEN z{j} > 0 THEN 1 ELSE 0.2::DOUBLE END AS d{j}' for j in range(hidden))} FROM hidden{step}),
    fired{step} AS (SELECT *, {', '.join(f'z{j} * d{j} AS h{j}' for j in range(hidden))} FROM active{step}),
    raw{step} AS (SELECT *, {', '.join(f'{e} AS o{k}' for k, e in enumerate(o))} FROM fired{step}),
    head{step} AS (SELECT *, o0 AS g, ln(1 + exp(o1)) + 1e-6::DOUBLE AS nu, ln(1 + exp(o2)) + 1 + 1e-6::DOUBLE AS al,
                          ln(1 + exp(o3)) + 1e-6::DOUBLE AS be, y - o0 AS e FROM raw{step}),
    big{step} AS (SELECT *, 2 * be * (1 + nu) AS om, nu * e * e + 2 * be * (1 + nu) AS big FROM head{step}),
    told{step} AS (
      SELECT *, 0.5::DOUBLE * ln(pi() / nu) - al * ln(om) + (al + 0.5::DOUBLE) * ln(big) + lgamma(al) - lgamma(al + 0.5::DOUBLE)
                + {lam}::DOUBLE * abs(e) * (2 * nu + al) AS loss,
             -2 * (al + 0.5::DOUBLE) * nu * e / big - {lam}::DOUBLE * sign(e) * (2 * nu + al) AS b0,
             (-0.5::DOUBLE / nu - al / (1 + nu) + (al + 0.5::DOUBLE) * (e * e + 2 * be) / big + 2 * {lam}::DOUBLE * abs(e)) / (1 + exp(-o1)) AS b1,
             (ln(big / om) + {_digamma_sql('al')} - {_digamma_sql('(al + 0.5::DOUBLE)')} + {lam}::DOUBLE * abs(e)) / (1 + exp(-o2)) AS b2,
             (-al / be + 2 * (al + 0.5::DOUBLE) * (1 + nu) / big) / (1 + exp(-o3)) AS b3 FROM big{step})""")
        back = [f"({' + '.join(f'b{k} * t{second + k + tasks * j}' for k in range(tasks))}) * d{j}" for j in range(hidden)]
        grads = {}
        for j in range(hidden):
            grads |= {j + hidden * i: f"avg({back[j]} * x{i})" for i in range(3)} | {first_bias + j: f"avg({back[j]})"}
        for k in range(tasks):
            grads |= {second + k + tasks * j: f"avg(b{k} * h{j})" for j in range(hidden)} | {second_bias + k: f"avg(b{k})"}
        full = {k: g + (f" + {2 * l2}::DOUBLE * any_value(t{k})" if k in kernels else "") for k, g in grads.items()}
        views.append(f"""
    grad{step} AS (SELECT slice, avg(loss) AS loss, {', '.join(f'{full[k]} AS g{k}' for k in range(at))} FROM told{step} WHERE NOT held GROUP BY slice),
    val{step} AS (SELECT slice, avg(loss) AS loss, avg(e * e) AS mse FROM told{step} WHERE held GROUP BY slice),
    moved{step} AS (SELECT w.slice, {', '.join(f't{k}, g{k}, 0.9::DOUBLE * v{k} + 0.1::DOUBLE * g{k} * g{k} AS v{k}' for k in range(at))}
                    FROM weights{step} w JOIN grad{step} USING (slice)),
    weights{step + 1} AS (SELECT slice, {', '.join(f't{k} - {rate}::DOUBLE * g{k} / (sqrt(v{k}) + 1e-7::DOUBLE) AS t{k}, v{k}' for k in range(at))}
                          FROM moved{step})""")
    rows = " UNION ALL ".join(
        f"SELECT slice, {step} AS epoch, grad{step}.loss AS train_loss, val{step + 1}.loss AS val_loss, val{step + 1}.mse AS val_mse "
        f"FROM grad{step} JOIN val{step + 1} USING (slice)"
        for step in range(_WHOLE_STEPS))
    columns = ", ".join(f"{r(c)} AS {c}" for c in ("train_loss", "val_loss", "val_mse"))
    return f"WITH {','.join(views)} SELECT slice, CAST(epoch AS INTEGER) AS epoch, {columns} FROM ({rows})"


def _whole_fit(spark, sf, steps: int, folder: str | None = None) -> evidential.EvidentialModel:
    rows = v.stored_panel(spark, sf, [*KEYS, "value", "rain", "snow"]).select(
        *KEYS, cal.season(F.month("time")).alias("slice"), (F.col("value") / 50).alias("a"), (F.col("rain") * 10).alias("b"),
        (F.col("snow") * 10).alias("c"), (F.col("value") / 25).alias("y"))
    held = F.year("time").isin(2000, 2001)
    return fit(rows.where(~held), rows.where(held), ["a", "b", "c"], ["y"], KEYS, by="slice", epochs=steps, batch_size=None,
               learning_rate=_WHOLE_RATE, folder=folder, seed=1, hidden_layers=1, hidden_neurons=2, l2_weight=0.01, loss_weight=0.1)


@query("fit_whole_batch", _fit_sql(), "panel")
def fit_whole_batch(spark, sf):
    """Losses of two steps of the whole gradient in each season: every derivative repeated by SQL."""
    return rounded(_whole_fit(spark, sf, _WHOLE_STEPS).history.select("slice", "epoch", "train_loss", "val_loss", "val_mse"))


@query("fit_resumed", _fit_sql(), "panel")
def fit_resumed(spark, sf):
    """The same fit, stopped after its first epoch and gone on with from the tables in its folder."""
    folder = shared_folder(spark, "fit")
    _whole_fit(spark, sf, 1, folder)
    return rounded(_whole_fit(spark, sf, _WHOLE_STEPS, folder).history.select("slice", "epoch", "train_loss", "val_loss", "val_mse"))


# ---- sensitivity -------------------------------------------------------------------------------

POINTS, HARMONICS, SEED, RESAMPLES = 10_000, 4, 0, 500
SENS_PARAMS = ["p1", "p2", "p3", "p4", "p5", "p6"]
_OWN = sensitivity.frequencies(len(SENS_PARAMS), POINTS, HARMONICS)[0]


# The study's largest sweep: 35 parameters, 100,000 points each.
WIDE_PARAMS, WIDE_POINTS = sorted(f"p{i}" for i in range(1, 36)), 100_000  # bounds come in order of names


def with_params(panel: DataFrame, sf: str) -> DataFrame:
    return reshape.attach_params(panel, v.sens_params(panel.sparkSession, sf))


def response(joined: DataFrame, by: list | None = None, params: Sequence[str] = SENS_PARAMS) -> DataFrame:
    """Slopes of the value on each parameter, and the parameters' means: a small closed-form emulator."""
    return joined.withColumns({"season": cal.season(F.month("time")), "month": F.month("time")}).groupBy(*(by or [])).agg(
        *[F.regr_slope("value", p).alias(f"{p}_slope") for p in params],
        *[F.avg(p).alias(f"{p}_mean") for p in params])


def emulated(points: DataFrame, fitted: DataFrame, by: list | None = None, params: Sequence[str] = SENS_PARAMS) -> DataFrame:
    """Linear response plus one interaction, for every point (and slice)."""
    packed = F.struct(*[c for c in fitted.columns if c not in (by or [])]).alias("c")
    if by:  # every point at every month or season, whose response it then meets by key
        fitted = stored(fitted, "response")
        slices = F.array(*[F.lit(x) for x in small_values(fitted, by[0])])
        points = points.withColumn(by[0], F.explode(slices)).join(fitted.select(*by, packed), by)
    else:
        points = points.withColumn("c", fitted.select(packed).scalar())
    term = {p: F.col(f"c.{p}_slope") * (F.col(p) - F.col(f"c.{p}_mean")) for p in params}
    y = reduce(add, term.values()) + 20 * term["p1"] * term["p2"]
    return points.select(*(by or []), "curve", "n", y.alias("y"))


def _sample_sql(params: Sequence[str] = SENS_PARAMS, points: int = POINTS, table: str = "sens_params") -> str:
    curves, phases = [], sensitivity.phases(len(params), SEED)
    own, others = sensitivity.frequencies(len(params), points, HARMONICS)
    for i, name in enumerate(params):
        columns = []
        for j, p in enumerate(params):
            omega = own if i == j else others[j if j < i else j - 1]
            turn = f"(({omega} * n) % {points}) / {points}.0::DOUBLE + {phases[i]!r}::DOUBLE + 0.25::DOUBLE"
            columns.append(f"{p}_lo + ({p}_hi - {p}_lo) * (1 - abs(2 * ({turn} - floor({turn})) - 1)) AS {p}")
        curves.append(f"SELECT '{name}' AS curve, n, {', '.join(columns)} FROM range({points}) AS o(n), bounds")
    ends = ", ".join(f"min({p}) AS {p}_lo, max({p}) AS {p}_hi" for p in params)
    return (f"bounds AS (SELECT {ends} FROM panel JOIN {table} USING (member)),\n"
            f"points AS ({' UNION ALL '.join(curves)})")


def _response_sql(by: str = "", params: Sequence[str] = SENS_PARAMS, table: str = "sens_params") -> str:
    fits = ", ".join(f"regr_slope(value, {p}) AS {p}_slope, avg({p}) AS {p}_mean" for p in params)
    term = {p: f"{p}_slope * ({p} - {p}_mean)" for p in params}
    y = f"{' + '.join(term.values())} + 20 * ({term['p1']}) * ({term['p2']})"
    if by:
        key = _SEASON.format(t="time") if by == "season" else "CAST(month(time) AS INTEGER)"
        return (f"fitted AS (SELECT {key} AS {by}, {fits} FROM panel JOIN sens_params USING (member) GROUP BY 1),\n"
                f"outputs AS (SELECT {by}, curve, n, {y} AS y FROM points, fitted)")
    return (f"fitted AS (SELECT {fits} FROM panel JOIN {table} USING (member)),\n"
            f"outputs AS (SELECT curve, n, {y} AS y FROM points, fitted)")


def _indices_sql(by: str = "") -> str:
    """Indices by direct Fourier sums over the low terms and the harmonics."""
    keys = f"{by}, curve" if by else "curve"
    angle = f"2 * pi() * ((k * n) % {POINTS}) / {POINTS}"
    terms = ", ".join(str(p * _OWN) for p in range(1, HARMONICS + 1))
    return f"""
    terms AS (SELECT unnest(range(1, {_OWN // 2 + 1})) AS k, 'low' AS kind
              UNION ALL SELECT unnest([{terms}]), 'own'),
    coefficients AS (SELECT {keys}, kind, k, sum(y * cos({angle})) AS a, sum(y * sin({angle})) AS b
                     FROM outputs, terms GROUP BY ALL),
    totals AS (SELECT {keys}, var_pop(y) * {float(POINTS) ** 2}::DOUBLE - {1 - POINTS % 2} * sum(y * (1 - 2 * (n % 2))) ** 2 AS v
               FROM outputs GROUP BY ALL),
    sens AS (SELECT {keys}, 2 * sum(a * a + b * b) FILTER (WHERE kind = 'own') / any_value(v) AS S1,
                    1 - 2 * sum(a * a + b * b) FILTER (WHERE kind = 'low') / any_value(v) AS ST
             FROM coefficients JOIN totals USING ({keys}) GROUP BY {keys})"""


def study_points(joined: DataFrame) -> DataFrame:
    """The sample between the parameters' bounds over all members that have panel rows."""
    bounds = aggregate.column_bounds(joined, SENS_PARAMS)
    return sensitivity.fast_sample(joined.sparkSession, bounds, POINTS, HARMONICS, SEED)


def study_outputs(spark: SparkSession, sf: str, by: list | None = None) -> DataFrame:
    joined = with_params(v.stored_panel(spark, sf, ["member", "time", "value"]), sf)
    return emulated(study_points(joined), response(joined, by), by)


def study_indices(spark: SparkSession, sf: str, by: list | None = None, n_bootstrap: int = 0) -> DataFrame:
    return sensitivity.fast_indices(
        study_outputs(spark, sf, by), HARMONICS, by=by or [], n_bootstrap=n_bootstrap, n_samples=POINTS)


_ALL = "panel sens_params"


@query("fast_sample", f"""
    WITH {_sample_sql()} SELECT curve, n, {r('p1', 4)} AS p1,
           {', '.join(f"{r(p)} AS {p}" for p in SENS_PARAMS[1:])} FROM points""", _ALL)
def fast_sample(spark, sf):
    return rounded(study_points(with_params(v.panel(spark, sf), sf)), p1=4)


@query("fast_first_order", f"""
    WITH {_sample_sql()}, {_response_sql()}, {_indices_sql()} SELECT curve AS name, {r('S1')} AS S1 FROM sens""", _ALL)
def fast_first_order(spark, sf):
    return rounded(sensitivity.fast_first_order(study_outputs(spark, sf), POINTS, HARMONICS))


def _wide_first_order_sql() -> str:
    own = sensitivity.frequencies(len(WIDE_PARAMS), WIDE_POINTS, HARMONICS)[0]
    angle = {p: f"2 * pi() * (({p * own} * n) % {WIDE_POINTS}) / {WIDE_POINTS}" for p in range(1, HARMONICS + 1)}
    sums = ", ".join(f"sum(y * cos({a})) AS c{p}, sum(y * sin({a})) AS s{p}" for p, a in angle.items())
    power = " + ".join(f"c{p} * c{p} + s{p} * s{p}" for p in angle)
    more = ", ".join(f"CAST((member * {2 * i + 1}) % {3 * i + 2} AS DOUBLE) AS p{i}" for i in range(7, 36))
    return f"""
    WITH wide_params AS (SELECT *, {more} FROM sens_params),
    {_sample_sql(WIDE_PARAMS, WIDE_POINTS, "wide_params")}, {_response_sql("", WIDE_PARAMS, "wide_params")},
    sums AS (SELECT curve, {sums}, var_pop(y) * {float(WIDE_POINTS) ** 2}::DOUBLE - sum(y * (1 - 2 * (n % 2))) ** 2 AS v
             FROM outputs GROUP BY 1)
    SELECT curve AS name, {r(f'2 * ({power}) / v')} AS S1 FROM sums"""


@query("fast_first_order_wide", _wide_first_order_sql(), _ALL)
def fast_first_order_wide(spark, sf):
    """First-order indices of 35 parameters from 3.5 million points."""
    key = F.col("member")
    params = v.sens_params(spark, sf).withColumns({f"p{i}": (key * (2 * i + 1) % (3 * i + 2)).cast("double") for i in range(7, 36)})
    joined = stored(reshape.attach_params(v.panel(spark, sf).select("member", "value", "time"), params), "wide")
    bounds = aggregate.column_bounds(joined, WIDE_PARAMS)
    points = sensitivity.fast_sample(spark, bounds, WIDE_POINTS, HARMONICS, SEED)
    outputs = emulated(points, response(joined, None, WIDE_PARAMS), None, WIDE_PARAMS)
    return rounded(sensitivity.fast_first_order(outputs, WIDE_POINTS, HARMONICS))


@query("fast_indices", f"""
    WITH {_sample_sql()}, {_response_sql()}, {_indices_sql()}
    SELECT curve AS name, {r('S1')} AS S1, {r('ST')} AS ST FROM sens""", _ALL)
def fast_indices(spark, sf):
    return rounded(study_indices(spark, sf).select("name", "S1", "ST"))


def _conf_sql() -> str:
    """Indices of every resample by plain weighted sums over the harmonics."""
    first, again, weight = sensitivity.draw_weights_sql("r", "n", SEED)
    harmonics = range(1, HARMONICS + 1)
    angle = {p: f"2 * pi() * (({p * _OWN} * n) % {POINTS}) / {POINTS}" for p in harmonics}
    waves = ", ".join(f"y * cos({angle[p]}) AS c{p}, y * sin({angle[p]}) AS s{p}" for p in harmonics)
    sums = ", ".join(f"sum(w * c{p}) AS c{p}, sum(w * s{p}) AS s{p}" for p in harmonics)
    power = " + ".join(f"c{p} * c{p} + s{p} * s{p}" for p in harmonics)
    return f"""
    centred AS (SELECT curve, n, y - avg(y) OVER (PARTITION BY curve) AS y FROM outputs),
    waves AS (SELECT curve, n, y, {waves} FROM centred),
    hashes AS (SELECT r, n, {first} AS x FROM range({RESAMPLES}) AS a(r), range({POINTS}) AS b(n)),
    hashed AS (SELECT r, n, {again.format(step=1)} AS x FROM hashes),
    drawn AS (SELECT r, n, {again.format(step=2)} AS x FROM hashed),
    draws AS (SELECT r, n, {weight} AS w FROM drawn),
    resampled AS (
      SELECT curve, r, {sums}, sum(w) AS w0, sum(w * y) AS w1, sum(w * y * y) AS w2 FROM waves JOIN draws USING (n) GROUP BY curve, r),
    conf AS (SELECT curve, {NormalDist().inv_cdf(0.975)!r}::DOUBLE * stddev_samp(2 * ({power}) / (w0 * w2 - w1 * w1)) AS S1_conf
             FROM resampled GROUP BY curve)"""


@query("fast_conf", f"""
    WITH {_sample_sql()}, {_response_sql()}, {_indices_sql()}, {_conf_sql()}
    SELECT curve AS name, {r('S1')} AS S1, {r('S1_conf')} AS S1_conf FROM sens JOIN conf USING (curve)""", _ALL)
def fast_conf(spark, sf):
    """First-order indices and how far they reach over 500 resamples."""
    return rounded(study_indices(spark, sf, n_bootstrap=RESAMPLES).select("name", "S1", "S1_conf"))


@query("fast_conf_total")
def fast_conf_total(spark, sf):
    """Total indices likewise; their 624 sums of each resample are too many for plain SQL."""
    return rounded(study_indices(spark, sf, n_bootstrap=RESAMPLES).select("name", "ST", "ST_conf"))


@query("fast_by_slice", f"""
    WITH {_sample_sql()}, {_response_sql('season')}, {_indices_sql('season')}
    SELECT season, curve AS name, {r('S1')} AS S1, {r('ST')} AS ST FROM sens""", _ALL)
def fast_by_slice(spark, sf):
    return rounded(study_indices(spark, sf, ["season"]).select("season", "name", "S1", "ST"))


@query("fast_by_month", f"""
    WITH {_sample_sql()}, {_response_sql('month')}, {_indices_sql('month')}
    SELECT month, curve AS name, {r('S1')} AS S1, {r('ST')} AS ST FROM sens""", _ALL)
def fast_by_month(spark, sf):
    return rounded(study_indices(spark, sf, ["month"]).select("month", "name", "S1", "ST"))


@query("sens_rank", f"""
    WITH {_sample_sql()}, {_response_sql('season')}, {_indices_sql('season')}
    SELECT season, curve AS name, {r('ST - S1', 5)} AS interactions,
           CAST(row_number() OVER (PARTITION BY season ORDER BY S1 DESC, curve) AS INTEGER) AS rank FROM sens""", _ALL)
def sens_rank(spark, sf):
    ranked = sensitivity.rank_indices(study_indices(spark, sf, ["season"]), ["season"])
    return rounded(ranked.select("season", "name", "interactions", "rank"), 5)


@query("sens_top4", f"""
    WITH {_sample_sql()}, {_response_sql('season')}, {_indices_sql('season')}
    SELECT season, curve AS name, {r('ST', 5)} AS ST,
           CAST(row_number() OVER (PARTITION BY season ORDER BY ST DESC, curve) AS INTEGER) AS rank FROM sens
    QUALIFY rank <= 4""", _ALL)
def sens_top4(spark, sf):
    top = sensitivity.top_indices(study_indices(spark, sf, ["season"]), 4, ["season"])
    return rounded(top.select("season", "name", "ST", "rank"), 5)


@query("fast_emulator")
def fast_emulator(spark, sf):
    """The whole chain in raw units: fit on quantile-scaled rows, sample between raw bounds with the
    forcing held at its mean, scale the assembled rows, score, analyse."""
    features = feature_names(v.params(spark, sf).drop("member_label"))
    samples = splits.split_member_time(study_samples(spark, sf), member_split(spark, sf), VAL_YEARS)
    used = stored(samples.where("split IS NOT NULL"), "samples")
    raw = used.where("split = 'train'")
    scaler = stored(scaling.fit_quantiles(raw, features), "scaler")
    target = stored(scaling.fit_standard(raw, ["target"]), "moments")
    scaled = scaling.standard_scale(scaling.quantile_scale(used, scaler, features), target, ["target"])
    model = fit(scaled.where("split = 'train'"), scaled.where("split = 'val'"), features, ["target"], KEYS, **ANNUAL)
    bounds = aggregate.column_bounds(raw, PARAMS)
    held = raw.agg(*[F.avg(f).alias(f) for f in features if f not in PARAMS])
    points = sensitivity.fast_sample(spark, bounds, POINTS, HARMONICS, SEED)
    assembled = reshape.assemble_inputs(points, held, features)
    scored = stored(model.score(scaling.quantile_scale(assembled, scaler, features)).select("curve", "n", "mu", "alea", "epis"), "scored")
    indices = [sensitivity.fast_indices(scored.select("curve", "n", F.col(c).alias("y")), HARMONICS, n_samples=POINTS)
               .withColumn("output", F.lit(c)) for c in ("mu", "alea", "epis")]
    return reshape.concat(indices).select("output", "name", "S1", "ST")


# ---- saved and read back ---------------------------------------------------------------------

@query("scaler_round_trip", QUANTILE_FIT_SQL, "panel pred")
def scaler_round_trip(spark, sf):
    folder = shared_folder(spark, "scaler")
    scaling.save_scaler(fitted_quantiles(quantile_samples(spark, sf)), folder)
    return rounded(scaling.load_scaler(spark, folder).select("feature", "k", "ref", "quantile"))


@query("model_round_trip", _score_sql(), "panel")
def model_round_trip(spark, sf):
    folder = shared_folder(spark, "model")
    _scored_model(spark).save(folder)
    return rounded(evidential.EvidentialModel.load(spark, folder).score(_score_inputs(spark, sf)).select(*KEYS, "mu", "alea", "epis"))


@query("sink_sensitivity", f"""
    WITH {_sample_sql()}, {_response_sql()}, {_indices_sql()}
    SELECT curve AS name, {r('S1')} AS S1, {r('ST')} AS ST FROM sens""", _ALL)
def sink_sensitivity(spark, sf):
    folder = shared_folder(spark, "sensitivity")
    src.write_csv(study_indices(spark, sf).select("name", "S1", "ST"), folder)
    return rounded(spark.read.csv(folder, header=True, schema="name string, S1 double, ST double"))


@query("split_checks", f"""
    WITH {_MEMBERS}
    SELECT split, count(*) AS n FROM (
      SELECT CASE WHEN member_split = 'train' AND year(time) NOT BETWEEN 2000 AND 2001 THEN 'train'
                  WHEN member_split = 'val' AND year(time) BETWEEN 2000 AND 2001 THEN 'val' END AS split
      FROM panel JOIN msplit USING (member)) WHERE split IS NOT NULL GROUP BY 1""", "panel pred")
def split_checks(spark, sf):
    """The split after its checks before any fit."""
    panel = v.stored_panel(spark, sf, KEYS)
    members = v.pred(spark, sf).select("member").distinct().count()
    n_train = members * 4 // 5
    splits.check_split_inputs(panel, panel, n_train, members - n_train, VAL_YEARS)
    found = splits.split_member_time(panel, member_split(spark, sf), VAL_YEARS)
    return found.where("split IS NOT NULL").groupBy("split").agg(F.count("*").alias("n"))
