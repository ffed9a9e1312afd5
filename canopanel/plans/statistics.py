"""Queries on means, anomalies, splits, scalers and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopanel.cluster import shared_folder, small_values, stored
from canopanel.functions import calendar as cal
from canopanel.functions.labels import member_id
from canopanel.operators import aggregate, anomaly, diagnostics as diag, moments, region, reshape, scaling, splits
from canopanel.plans import views as v
from canopanel.plans.registry import query, r, rounded
from canopanel.plans.tables import _BOX, _STACK, cal_slices, conus_panel
from canopanel.sources import tables as src

KEYS = ["member", "time", "gridcell"]
BASELINE, PERIOD, VAL_YEARS = ("1995", "1999"), ("2000", "2001"), (2000, 2001)
_K = ", ".join(v.PRED_KEYS)
_SEASON = "CASE WHEN month({t}) IN (12, 1, 2) THEN 'DJF' WHEN month({t}) <= 5 THEN 'MAM' " \
          "WHEN month({t}) <= 8 THEN 'JJA' ELSE 'SON' END"
_PRED_SEASON = "CASE WHEN month IN (12, 1, 2) THEN 'DJF' WHEN month <= 5 THEN 'MAM' " \
               "WHEN month <= 8 THEN 'JJA' ELSE 'SON' END"


# ---- aggregations ----------------------------------------------------------------------

@query("time_mean", f"SELECT member, gridcell, {r('avg(value)')} AS value FROM panel GROUP BY 1, 2", "panel")
def time_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(aggregate.mean_by(v.panel(spark, sf), ["member", "gridcell"], ["value"]))


@query("climatology", f"""
    SELECT gridcell, CAST(month(time) AS INTEGER) AS month, {r('avg(value)')} AS clim_mean,
           {r('stddev_pop(value)')} AS clim_std
    FROM panel WHERE year(time) BETWEEN 1995 AND 1999 GROUP BY 1, 2""", "panel")
def climatology(spark, sf):
    return rounded(aggregate.climatology(v.panel(spark, sf, BASELINE)))


_GROWN = f"""
    SELECT gridcell, CAST(month(time) AS INTEGER) AS month, {r('avg(value)')} AS clim_mean,
           {r('stddev_pop(value)')} AS clim_std
    FROM panel WHERE year(time) BETWEEN 1995 AND 1999 GROUP BY 1, 2"""


@query("climatology_grown", _GROWN, "panel")
def climatology_grown(spark, sf):
    """Four years' moments, stored, then a fifth year: only its rows are read and merged."""
    keys, folder = ["gridcell", "month"], shared_folder(spark, "moments")
    by_month = lambda first, last: v.panel(spark, sf, (first, last)).withColumn("month", F.month("time"))
    moments.moments(by_month("1995", "1998"), keys, ["value"]).write.parquet(folder)
    grown = moments.update(spark.read.parquet(folder), by_month("1999", "1999"), keys, ["value"])
    return rounded(moments.to_climatology(grown, keys))


@query("scaler_grown", f"""
    SELECT {', '.join(f"{r(f'avg({c})')} AS {c}_mean, {r(f'stddev_pop({c})')} AS {c}_std" for c in ('value', 'rain', 'snow'))}
    FROM panel WHERE year(time) BETWEEN 1995 AND 1999""", "panel")
def scaler_grown(spark, sf):
    """A standard scaler of a panel that has grown by a year since its moments were stored."""
    columns, folder = ["value", "rain", "snow"], shared_folder(spark, "moments")
    moments.moments(v.panel(spark, sf, ("1995", "1998")), [], columns).write.parquet(folder)
    grown = moments.update(spark.read.parquet(folder), v.panel(spark, sf, ("1999", "1999")), [], columns)
    return rounded(moments.to_scaler(grown, columns))


@query("seasonal_mean", f"""
    SELECT member, gridcell, {_SEASON.format(t='time')} AS season, {r('avg(value)')} AS value
    FROM panel GROUP BY 1, 2, 3""", "panel")
def seasonal_mean(spark, sf):
    return rounded(aggregate.seasonal_mean(v.panel(spark, sf), ["member", "gridcell"]))


_REGION_JOIN = f"panel JOIN weights USING (gridcell) WHERE gridcell IN (SELECT gridcell FROM grid WHERE {_BOX})"


# The weights of all cells of the region, whichever of them a sparse month has.
_REGION_AREA = f"(SELECT sum(landarea) FROM weights WHERE gridcell IN (SELECT gridcell FROM grid WHERE {_BOX}))"


def region_area_mean(spark: SparkSession, sf: str) -> DataFrame:
    cells = region.box_cells(v.grid(spark, sf), region.CONUS)
    return aggregate.area_mean(conus_panel(spark, sf), v.weights(spark, sf), selected=cells)


@query("area_weighted_mean", f"""
    SELECT member, time, {r(f'sum(value * landarea) / {_REGION_AREA}')} AS value
    FROM {_REGION_JOIN} GROUP BY 1, 2""", "panel grid weights")
def area_weighted_mean(spark, sf):
    return rounded(region_area_mean(spark, sf))


@query("area_mean_all_land", f"""
    SELECT member, time, {r('sum(value * landarea) / (SELECT sum(landarea) FROM weights)')} AS value
    FROM {_REGION_JOIN} GROUP BY 1, 2""", "panel grid weights")
def area_mean_all_land(spark, sf):
    return rounded(aggregate.area_mean(conus_panel(spark, sf), v.weights(spark, sf), denominator="all"))


_ALL_AREA = "(SELECT sum(landarea) FROM weights WHERE gridcell IN (SELECT gridcell FROM grid))"


@query("area_mean_multi", f"""
    SELECT member, time, {', '.join(f"{r(f'2.0::DOUBLE * sum({c} * landarea) / {_ALL_AREA}')} AS {c}"
                                    for c in ('value', 'rain', 'snow'))}
    FROM panel JOIN weights USING (gridcell) GROUP BY 1, 2""", "panel grid weights")
def area_mean_multi(spark, sf):
    return rounded(aggregate.area_mean(
        v.panel(spark, sf), v.weights(spark, sf), values=["value", "rain", "snow"], scale_factor=2.0,
        selected=v.grid(spark, sf).select("gridcell")))


@query("seasonal_region_mean", f"""
    SELECT member, {_SEASON.format(t='time')} AS season, {r('avg(value)')} AS value FROM (
      SELECT member, time, sum(value * landarea) / {_REGION_AREA} AS value FROM {_REGION_JOIN} GROUP BY 1, 2)
    GROUP BY 1, 2""", "panel grid weights")
def seasonal_region_mean(spark, sf):
    """Seasonal area-weighted regional mean per member."""
    return rounded(aggregate.seasonal_mean(region_area_mean(spark, sf), ["member"]))


@query("spatial_mean", f"""
    SELECT time, {r('avg(a)')} AS lai FROM (
      SELECT time, lai - avg(lai) OVER (PARTITION BY lat, lon) AS a FROM obs) GROUP BY 1""", "obs")
def spatial_mean(spark, sf):
    anomalies = anomaly.time_mean_anomaly(v.obs(spark, sf), ["lat", "lon"], "lai", "a")
    return rounded(aggregate.mean_by(anomalies, ["time"], ["a"]).withColumnRenamed("a", "lai"))


@query("monthly_trend", f"""
    SELECT month, {', '.join(f"{r(f'avg({c})', 4)} AS {c}_mean, {r(f'stddev_samp({c})', 4)} AS {c}_std"
                             for c in ('truth', 'mu'))} FROM pred GROUP BY 1""", "pred")
def monthly_trend(spark, sf):
    return rounded(aggregate.trend_by(v.pred(spark, sf), ["month"], ["truth", "mu"]), 4)


_MEANS = ", ".join(f"{r(f'avg({c})', 4)} AS {c}" for c in ("mu", "truth", "alea", "epis"))


@query("slice_means", f"SELECT {_PRED_SEASON} AS slice, {_MEANS} FROM pred GROUP BY 1", "pred")
def slice_means(spark, sf):
    return rounded(aggregate.mean_by(cal_slices(v.pred(spark, sf)), ["slice"], ["mu", "truth", "alea", "epis"]), 4)


@query("member_means", f"SELECT member, {_MEANS} FROM pred GROUP BY 1", "pred")
def member_means(spark, sf):
    return rounded(aggregate.mean_by(v.pred(spark, sf), ["member"], ["mu", "truth", "alea", "epis"]), 4)


@query("monthly_uncertainty", f"""
    SELECT month, {r('avg(alea)')} AS alea, {r('avg(epis)')} AS epis, {r('avg(alea + epis)')} AS total
    FROM pred GROUP BY 1 ORDER BY avg(alea + epis) DESC""", "pred")
def monthly_uncertainty(spark, sf):
    return rounded(aggregate.uncertainty_by(v.pred(spark, sf), ["month"]).orderBy(F.desc("total"), "month"))


@query("peak_trough", """
    WITH m AS (SELECT month, avg(truth) AS truth, avg(mu) AS mu FROM pred GROUP BY 1)
    SELECT (SELECT month FROM m ORDER BY truth DESC, month LIMIT 1) AS truth_peak,
           (SELECT month FROM m ORDER BY truth, month LIMIT 1) AS truth_trough,
           (SELECT month FROM m ORDER BY mu DESC, month LIMIT 1) AS mu_peak,
           (SELECT month FROM m ORDER BY mu, month LIMIT 1) AS mu_trough""", "pred")
def peak_trough(spark, sf):
    means = aggregate.mean_by(v.pred(spark, sf), ["month"], ["truth", "mu"])
    return aggregate.peak_trough(means, "month", ["truth", "mu"])


@query("param_bounds", "\nUNION ALL ".join(
    f"SELECT '{p}' AS name, min({p}) AS lo, max({p}) AS hi, {r(f'avg({p})')} AS mean FROM pq"
    for p in ("p1", "p2", "p3", "value")).join(
        ["WITH pq AS (SELECT p1, p2, p3, value FROM panel JOIN params USING (member))\n", ""]), "panel params")
def param_bounds(spark, sf):
    joined = v.panel(spark, sf).join(v.params(spark, sf), "member")
    return rounded(aggregate.column_bounds(joined, ["p1", "p2", "p3", "value"]))


@query("target_variance", f"""
    SELECT {', '.join(f"{r(f'var_pop({c})')} AS {c}_var" for c in ('value', 'rain', 'snow'))}
    FROM panel WHERE year(time) < 2000""", "panel")
def target_variance(spark, sf):
    train = v.panel(spark, sf, ("1901", "1999"))
    return rounded(aggregate.target_variance(train, ["value", "rain", "snow"]))


@query("line_means", f"""
    SELECT member, month, {r('avg(truth)', 4)} AS truth, {r('avg(mu)', 4)} AS mu FROM pred GROUP BY 1, 2""", "pred")
def line_means(spark, sf):
    return rounded(aggregate.mean_by(v.pred(spark, sf), ["member", "month"], ["truth", "mu"]), 4)


@query("season_year_means", f"""
    SELECT member, {_SEASON.format(t='time')} AS season, CAST(year(time) + CASE WHEN month(time) = 12 THEN 1 ELSE 0 END AS INTEGER) AS year,
           {r('avg(value)')} AS value FROM panel GROUP BY 1, 2, 3""", "panel")
def season_year_means(spark, sf):
    """Seasonal means of each year, a December in the winter it begins."""
    return rounded(aggregate.mean_by(v.panel(spark, sf).withColumns(
        {"season": cal.season(F.month("time")), "year": cal.season_year(F.col("time"))}), ["member", "season", "year"], ["value"]))


@query("dense_gaps", """
    SELECT member, count(*) AS n, count(*) FILTER (WHERE value IS NULL) AS missing
    FROM (SELECT member, time, gridcell FROM (SELECT DISTINCT member FROM panel), (SELECT DISTINCT time FROM panel),
                                             (SELECT DISTINCT gridcell FROM panel))
         LEFT JOIN panel USING (member, time, gridcell) GROUP BY 1""", "panel")
def dense_gaps(spark, sf):
    """How many months and cells each member lacks in the full cube."""
    panel = v.stored_panel(spark, sf, [*KEYS, "value"])
    dense = reshape.densify(panel, {k: small_values(panel, k) for k in ("time", "gridcell")}, KEYS)
    return dense.groupBy("member").agg(
        F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("missing"))


@query("unstack_vectors", f"""
    SELECT member, time, gridcell, {r('value')} AS value FROM panel""", "panel")
def unstack_vectors(spark, sf):
    """All cells of a sample as one vector of outputs, and back to rows."""
    cells = small_values(v.grid(spark, sf), "gridcell")
    wide = reshape.stack_multitask(v.panel(spark, sf), cells)
    vectors = reshape.feature_vector(wide, [f"cell_{c}" for c in cells], "y").select("member", "time", "y")
    return rounded(reshape.unstack_array(vectors, ["member", "time"], "y", cells).where("value IS NOT NULL"))


# ---- anomalies ---------------------------------------------------------------------------

@query("anomaly_time_mean", f"""
    SELECT member, time, gridcell, {r('value - avg(value) OVER (PARTITION BY member, gridcell)')} AS anomaly
    FROM panel""", "panel")
def anomaly_time_mean(spark, sf):
    return rounded(anomaly.time_mean_anomaly(v.stored_panel(spark, sf, [*KEYS, "value"])).select(*KEYS, "anomaly"))


_CLIM = """
    SELECT member, time, p.gridcell, {value} AS anomaly
    FROM panel p LEFT JOIN (
      SELECT gridcell, month(time) AS month, avg(value) AS m, stddev_pop(value) AS s FROM panel
      WHERE year(time) BETWEEN 1995 AND 1999 GROUP BY 1, 2) c ON p.gridcell = c.gridcell AND month(time) = c.month
    WHERE year(time) BETWEEN 2000 AND 2001"""


@query("anomaly_clim", _CLIM.format(value=r("value - m")), "panel")
def anomaly_clim(spark, sf):
    return rounded(anomaly.anomaly(
        v.panel(spark, sf, PERIOD), "clim", BASELINE, PERIOD, base=v.panel(spark, sf, BASELINE)).select(*KEYS, "anomaly"))


@query("anomaly_zscore", _CLIM.format(value=r("(value - m) / (s + 1e-9)")), "panel")
def anomaly_zscore(spark, sf):
    return rounded(anomaly.anomaly(
        v.panel(spark, sf, PERIOD), "zscore", BASELINE, PERIOD, base=v.panel(spark, sf, BASELINE)).select(*KEYS, "anomaly"))


# ---- splits ------------------------------------------------------------------------------

def member_split(spark: SparkSession, sf: str) -> DataFrame:
    """First 80 % of the sorted members train, the rest validate."""
    members = stored(v.pred(spark, sf).select("member").distinct(), "members")
    found = members.count()
    n_train = found * 4 // 5
    return splits.split_members(members, n_train, found - n_train, strict=True)


def split_panel(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_member_time(v.panel(spark, sf), member_split(spark, sf), VAL_YEARS)


def stored_split(spark: SparkSession, sf: str) -> DataFrame:
    """The split panel without its discarded blocks, written once."""
    return stored(split_panel(spark, sf).where("split IS NOT NULL"), "split")


_MEMBERS = """msplit AS (
      SELECT member, CASE WHEN i < n * 4 // 5 THEN 'train' ELSE 'val' END AS member_split FROM (
        SELECT member, row_number() OVER (ORDER BY member) - 1 AS i, count(*) OVER () AS n
        FROM (SELECT DISTINCT member FROM pred)))"""
_SPLIT = _MEMBERS + """, sp AS (
      SELECT p.*, CASE WHEN member_split = 'train' AND year(time) NOT BETWEEN 2000 AND 2001 THEN 'train'
                       WHEN member_split = 'val' AND year(time) BETWEEN 2000 AND 2001 THEN 'val' END AS split
      FROM panel p LEFT JOIN msplit USING (member))"""


@query("split_members", f"WITH {_MEMBERS} SELECT member, member_split FROM msplit", "pred")
def split_members(spark, sf):
    return member_split(spark, sf)


@query("split_years", """
    SELECT member, time, gridcell,
           CASE WHEN year(time) BETWEEN 2000 AND 2001 THEN 'val' ELSE 'train' END AS split FROM panel""", "panel")
def split_years(spark, sf):
    return v.panel(spark, sf).select(*KEYS, splits.year_split(F.col("time"), VAL_YEARS).alias("split"))


@query("split_member_time", f"WITH {_SPLIT} SELECT member, time, gridcell, split FROM sp", "panel pred")
def split_member_time(spark, sf):
    return split_panel(spark, sf).select(*KEYS, "split")


@query("split_masks", f"""
    WITH {_SPLIT} SELECT member_label AS member, time, gridcell, coalesce(split = 'train', false) AS train_mask,
           coalesce(split = 'val', false) AS val_mask FROM sp JOIN params USING (member)""", "panel pred params")
def split_masks(spark, sf):
    """Masks for samples whose members are labels, from a split of integer ids."""
    labels = v.params(spark, sf).select(member_id(F.col("member_label")).alias("member"), "member_label")
    samples = stored(v.panel(spark, sf).join(labels, "member").select(
        F.col("member_label").alias("member"), "time", "gridcell"), "samples")
    n = v.pred(spark, sf).select("member").distinct().count()
    splits.check_split_inputs(samples, samples, n * 4 // 5, n - n * 4 // 5, VAL_YEARS)
    return splits.split_masks(samples, member_split(spark, sf), VAL_YEARS)


@query("split_artifacts", f"""
    WITH {_SPLIT}
    SELECT member_split || '_member' AS kind, member AS value FROM msplit
    UNION ALL SELECT DISTINCT split || '_year', CAST(year(time) AS BIGINT) FROM sp WHERE split IS NOT NULL
    UNION ALL SELECT 'n_' || split, count(*) FROM sp WHERE split IS NOT NULL GROUP BY split
    UNION ALL SELECT split || '_index', sample_id FROM sp JOIN ({_STACK}) USING (member, time, gridcell)
              WHERE split IS NOT NULL""", "panel pred")
def split_artifacts(spark, sf):
    members = member_split(spark, sf)
    samples = reshape.stack_samples(v.stored_panel(spark, sf).select(*KEYS))
    return splits.split_artifacts(
        stored(splits.split_member_time(samples, members, VAL_YEARS), "split"), members, sample_id="sample_id")


@query("split_coverage", f"""
    WITH {_SPLIT} SELECT split, CAST(min(year(time)) AS INTEGER) AS first_year,
           CAST(max(year(time)) AS INTEGER) AS last_year, count(DISTINCT year(time)) AS n_years,
           count(*) AS n_samples FROM sp WHERE split IS NOT NULL GROUP BY 1""", "panel pred")
def split_coverage(spark, sf):
    return splits.split_coverage(split_panel(spark, sf))


@query("sink_split", f"""
    WITH {_SPLIT} SELECT member, time, gridcell, {r('value')} AS value, {r('rain')} AS rain, split FROM sp
    WHERE split IS NOT NULL""", "panel pred")
def sink_split(spark, sf):
    folder = shared_folder(spark, "split")
    src.write_split(split_panel(spark, sf).select(*KEYS, "value", "rain", "split"), folder)
    return rounded(src.open_table(spark, folder, [*KEYS, "value", "rain", "split"]))


@query("split_chrono", """
    SELECT member, time, gridcell, time < DATE '2000-01-01' AS in_train, time >= DATE '1999-01-01' AS in_val,
           year(time) = 1999 AS overlap FROM panel""", "panel")
def split_chrono(spark, sf):
    return splits.split_periods(v.panel(spark, sf).select(*KEYS), ("1901", "1999"), ("1999", "2014"))


@query("slice_month", f"""
    SELECT CAST(month(time) AS INTEGER) AS slice, member, count(*) AS n, {r('avg(value)')} AS value
    FROM panel GROUP BY 1, 2""", "panel")
def slice_month(spark, sf):
    return rounded(splits.with_month_slice(v.panel(spark, sf)).groupBy("slice", "member").agg(
        F.count("*").alias("n"), F.avg("value").alias("value")))


@query("slice_season", f"""
    SELECT {_SEASON.format(t='time')} AS slice, member, count(*) AS n, {r('avg(value)')} AS value
    FROM panel GROUP BY 1, 2""", "panel")
def slice_season(spark, sf):
    return rounded(splits.with_season_slice(v.panel(spark, sf)).groupBy("slice", "member").agg(
        F.count("*").alias("n"), F.avg("value").alias("value")))


# ---- scalers -------------------------------------------------------------------------------

COLUMNS = ["value", "rain", "snow"]


def _scaled_sql(by: str) -> str:
    group = f"GROUP BY {by}" if by else ""
    join = f"LEFT JOIN m USING ({by})" if by else ", m"
    first = f"{by}, " if by else ""
    moments = ", ".join(f"avg({c}) AS {c}_m, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS {c}_s"
                        for c in COLUMNS)
    scaled = ", ".join(f"{r(f'(x.{c} - {c}_m) / {c}_s')} AS {c}" for c in COLUMNS)
    return f"""
    WITH {_SPLIT}, x AS (SELECT *, CAST(month(time) AS INTEGER) AS slice FROM sp WHERE split IS NOT NULL),
    m AS (SELECT {first}{moments} FROM x WHERE split = 'train' {group})
    SELECT member, time, {'' if by == 'gridcell' else 'gridcell, '}{first}split, {scaled} FROM x {join}"""


def _scaled(spark, sf, by: list[str]) -> DataFrame:
    samples = splits.with_month_slice(stored_split(spark, sf))
    moments = scaling.fit_standard(samples.where("split = 'train'"), COLUMNS, by)
    keep = [*KEYS, *[c for c in by if c not in KEYS], "split"]
    return rounded(scaling.standard_scale(samples, moments, COLUMNS, by).select(*keep, *COLUMNS))


@query("standard_scale", _scaled_sql(""), "panel pred")
def standard_scale(spark, sf):
    return _scaled(spark, sf, [])


@query("standard_scale_by_slice", _scaled_sql("slice"), "panel pred")
def standard_scale_by_slice(spark, sf):
    return _scaled(spark, sf, ["slice"])


@query("standard_scale_by_cell", _scaled_sql("gridcell"), "panel pred")
def standard_scale_by_cell(spark, sf):
    return _scaled(spark, sf, ["gridcell"])


@query("inverse_scale", f"""
    SELECT {_K}, {r('mu / 1e4 * s + m', 1)} AS mu
    FROM pred, (SELECT avg(truth) AS m, stddev_pop(truth) AS s FROM pred)""", "pred")
def inverse_scale(spark, sf):
    """``mu / 1e4`` read as a scaled prediction and put back on the scale of the truth."""
    p = v.pred(spark, sf)
    moments = scaling.fit_standard(p, ["truth"]).withColumnsRenamed({"truth_mean": "mu_mean", "truth_std": "mu_std"})
    scaled = p.select(*v.PRED_KEYS, (F.col("mu") / 1e4).alias("mu"))
    return rounded(scaling.inverse_scale(scaled, moments, ["mu"]), 1)


# Quantile maps jump at ties, so the last bit of a mean must not decide: round the means first.
_QUANTILES = f"""{_SPLIT}, sq AS (
      SELECT member, time, gridcell, split, {', '.join(f"{r(c, 9)} AS {c}" for c in COLUMNS)} FROM sp),
    ql AS ({' UNION ALL '.join(f'''
      SELECT '{c}' AS feature, list_sort(list({c})) AS vs, count({c}) AS n FROM sq WHERE split = 'train' ''' for c in COLUMNS)}),
    qk AS (SELECT feature, k, vs[(k * (n - 1)) // 999 + 1] AS lo, vs[(k * (n - 1)) // 999 + 2] AS hi,
                  (k * (n - 1)) % 999 / 999.0::DOUBLE AS part FROM ql, range(1000) AS o(k)),
    q AS (SELECT feature, k, CASE WHEN part > 0 THEN lo + (hi - lo) * part ELSE lo END AS quantile,
                 k / 999.0::DOUBLE AS ref FROM qk)"""


def quantile_samples(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stored_split(spark, sf).select(*KEYS, "split", *COLUMNS), 9)


def fitted_quantiles(samples: DataFrame) -> DataFrame:
    return scaling.fit_quantiles(samples.where("split = 'train'"), COLUMNS)


QUANTILE_FIT_SQL = f"""
    WITH {_QUANTILES} SELECT feature, k, {r('ref')} AS ref, {r('quantile')} AS quantile FROM q"""


@query("quantile_fit", QUANTILE_FIT_SQL, "panel pred")
def quantile_fit(spark, sf):
    return rounded(fitted_quantiles(quantile_samples(spark, sf)).select("feature", "k", "ref", "quantile"))


@query("quantile_transform", f"""
    WITH {_QUANTILES},
    x AS ({' UNION ALL '.join(
        f"SELECT member, time, gridcell, '{c}' AS feature, {c} AS v FROM sq WHERE split IS NOT NULL" for c in COLUMNS)}),
    ends AS (SELECT feature, min(quantile) AS q0, max(quantile) AS q1 FROM q GROUP BY 1),
    seg AS (SELECT feature, quantile AS lo, lead(quantile) OVER w AS hi, ref AS r0, lead(ref) OVER w AS r1
            FROM q WINDOW w AS (PARTITION BY feature ORDER BY k)),
    ties AS (SELECT feature, quantile AS lo, avg(ref) AS r0 FROM (
             SELECT feature, quantile, unnest([min(ref), max(ref)]) AS ref FROM q GROUP BY 1, 2) GROUP BY 1, 2),
    out AS (
      SELECT x.*, CASE WHEN v <= q0 THEN 0.0 WHEN v >= q1 THEN 1.0 WHEN ties.r0 IS NOT NULL THEN ties.r0
                       ELSE seg.r0 + (v - seg.lo) / (seg.hi - seg.lo) * (seg.r1 - seg.r0) END AS u
      FROM x JOIN ends USING (feature)
      LEFT JOIN ties ON ties.feature = x.feature AND ties.lo = v
      LEFT JOIN seg ON seg.feature = x.feature AND seg.lo < v AND v < seg.hi)
    SELECT member, time, gridcell, {', '.join(
        f"{r(f'''max(u) FILTER (WHERE feature = '{c}')''', 5)} AS {c}" for c in COLUMNS)}
    FROM out GROUP BY 1, 2, 3""", "panel pred")
def quantile_transform(spark, sf):
    samples = quantile_samples(spark, sf)
    fitted = fitted_quantiles(samples)
    return rounded(scaling.quantile_scale(samples, fitted, COLUMNS).select(*KEYS, *COLUMNS), 5)


# ---- diagnostics -----------------------------------------------------------------------------

_METRICS = ", ".join([
    f"{r('1 - avg((truth - mu) ** 2) / var_pop(truth)')} AS r2", f"{r('avg((truth - mu) ** 2)', 2)} AS mse",
    f"{r('sqrt(avg((truth - mu) ** 2))', 4)} AS rmse", f"{r('avg(abs(truth - mu))', 4)} AS mae",
    "min(truth) AS truth_min", "max(truth) AS truth_max", "count(*) AS n"])


def _metrics(df: DataFrame) -> DataFrame:
    return rounded(df, r2=6, mse=2, rmse=4, mae=4, truth_min=6, truth_max=6)


@query("regression_metrics", f"SELECT {_METRICS} FROM pred", "pred")
def regression_metrics(spark, sf):
    return _metrics(diag.regression_metrics(v.pred(spark, sf)))


@query("regression_metrics_by_slice", f"SELECT month, {_METRICS} FROM pred GROUP BY 1", "pred")
def regression_metrics_by_slice(spark, sf):
    return _metrics(diag.regression_metrics(v.pred(spark, sf), ["month"]))


@query("error_columns", f"""
    SELECT {_K}, {r('abs(truth - mu)', 4)} AS abs_error, {r('alea + epis', 4)} AS total FROM pred""", "pred")
def error_columns(spark, sf):
    return rounded(diag.with_errors(v.pred(spark, sf)).select(*v.PRED_KEYS, "abs_error", "total"), 4)


@query("error_over_time", f"SELECT time, {r('avg(abs(truth - mu))', 4)} AS abs_error FROM pred GROUP BY 1", "pred")
def error_over_time(spark, sf):
    return rounded(aggregate.mean_by(diag.with_errors(v.pred(spark, sf)), ["time"], ["abs_error"]), 4)


def _bin_sql(x: str, lo: str, hi: str, bins: int) -> str:
    """Bin by the edges ``lo + b * width``: a first guess, moved by one where rounding misplaced it."""
    width = f"(({hi} - {lo}) / {bins})"
    guess = f"floor(({x} - {lo}) / {width})"
    return (f"CAST(least({bins - 1}, {guess} - CASE WHEN {x} < {lo} + {guess} * {width} THEN 1 ELSE 0 END"
            f" + CASE WHEN {x} >= {lo} + ({guess} + 1) * {width} THEN 1 ELSE 0 END) AS INTEGER)")


def _histogram_sql(columns: list[str], bins: int) -> str:
    values = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS x FROM e" for c in columns)
    return f"""
    WITH e AS (SELECT *, abs(truth - mu) AS abs_error FROM pred), xs AS ({values}),
    b AS (SELECT min(x) AS lo, max(x) AS hi FROM xs),
    n AS (SELECT feature, {_bin_sql('x', 'lo', 'hi', bins)} AS bin, count(*) AS n
          FROM xs, b GROUP BY 1, 2)
    SELECT f.feature, CAST(o.i AS INTEGER) AS bin, {r(f'lo + (hi - lo) / {bins} * o.i', 5)} AS "left",
           {r(f'lo + (hi - lo) / {bins} * (o.i + 1)', 5)} AS "right", coalesce(n.n, 0) AS n
    FROM (SELECT unnest({columns}) AS feature) f, range({bins}) AS o(i), b
    LEFT JOIN n ON n.feature = f.feature AND n.bin = o.i"""


@query("histogram", _histogram_sql(["abs_error"], 50), "pred")
def histogram(spark, sf):
    return rounded(diag.histogram(diag.with_errors(v.pred(spark, sf)), ["abs_error"], 50), 5)


@query("histogram_shared", _histogram_sql(["mu", "truth"], 49), "pred")
def histogram_shared(spark, sf):
    return rounded(diag.histogram(v.pred(spark, sf), ["mu", "truth"], 49), 5)


@query("histogram_2d", f"""
    WITH s AS (SELECT sqrt(alea) AS x, sqrt(epis) AS y FROM pred),
    b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM s)
    SELECT {_bin_sql('x', 'x0', 'x1', 50)} AS x_bin, {_bin_sql('y', 'y0', 'y1', 50)} AS y_bin, count(*) AS n
    FROM s, b GROUP BY 1, 2 HAVING count(*) >= 7""", "pred")
def histogram_2d(spark, sf):
    return diag.histogram_2d(diag.with_sigma(v.pred(spark, sf)), "alea_sigma", "epis_sigma")


@query("gaussian_fit", f"""
    WITH e AS (SELECT mu - truth AS x FROM pred),
    m AS (SELECT avg(x) AS mean, stddev_pop(x) AS std, min(x) AS lo, max(x) AS hi, count(*) AS n FROM e),
    g AS (SELECT i, lo + (hi - lo) * i / 499 AS x, m.* FROM range(500) AS o(i), m)
    SELECT i, {r('x', 4)} AS x,
           {r('exp(-0.5 * ((x - mean) / std) ** 2) / (std * sqrt(2 * pi())) * n * (hi - lo) / 50', 4)} AS y FROM g""",
       "pred")
def gaussian_fit(spark, sf):
    errors = v.pred(spark, sf).select((F.col("mu") - F.col("truth")).alias("e"))
    return rounded(diag.gaussian_fit(errors, "e"), 4)


@query("kde", f"""
    WITH e AS (SELECT abs(truth - mu) AS x FROM pred),
    m AS (SELECT stddev_samp(x) * count(x) ** (-0.2) AS h, min(x) AS lo, max(x) AS hi, count(x) AS n FROM e)
    SELECT i, {r('any_value(lo + (hi - lo) * i / 199)', 4)} AS x,
           {r('sum(exp(-0.5 * ((lo + (hi - lo) * i / 199 - x) / h) ** 2)) / any_value(n * h * sqrt(2 * pi()))', 9)} AS density
    FROM e, m, range(200) AS o(i) GROUP BY i""", "pred")
def kde(spark, sf):
    return rounded(diag.kde(diag.with_errors(v.pred(spark, sf)), "abs_error"), x=4, density=9)


_CORR = ["truth", "mu", "alea", "epis", "abs_error"]


@query("corr_matrix", "WITH e AS (SELECT *, abs(truth - mu) AS abs_error FROM pred)\n" + "\nUNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})')} AS r FROM e" for a in _CORR for b in _CORR), "pred")
def corr_matrix(spark, sf):
    return rounded(diag.corr_matrix(diag.with_errors(v.pred(spark, sf)), _CORR))


@query("discard_test", f"""
    WITH u AS (SELECT *, 'alea' AS measure, alea AS u FROM pred UNION ALL SELECT *, 'epis', epis FROM pred),
    k AS (SELECT month, measure, (truth - mu) ** 2 AS sq, count(*) OVER (PARTITION BY month, measure) AS n,
                 row_number() OVER (PARTITION BY month, measure ORDER BY u, {_K}) AS rn FROM u)
    SELECT month, measure, i, count(*) AS kept, {r('sqrt(avg(sq))', 4)} AS rmse
    FROM k, range(11) AS o(i) WHERE rn <= n - (i * n) // 20 GROUP BY 1, 2, 3""", "pred")
def discard_test(spark, sf):
    return rounded(diag.discard_test(v.pred(spark, sf), ["alea", "epis"], v.PRED_KEYS, ["month"]), 4)


@query("bias_variance", f"""
    SELECT month, {r('avg(mu - truth)', 4)} AS bias, {r('var_pop(mu - truth)', 2)} AS variance
    FROM pred GROUP BY 1""", "pred")
def bias_variance(spark, sf):
    return rounded(diag.bias_variance(v.pred(spark, sf), ["month"]), bias=4, variance=2)


@query("confidence_interval", f"""
    SELECT {_K}, {r('mu - 1.96 * sqrt(alea + epis)', 4)} AS lower, {r('mu + 1.96 * sqrt(alea + epis)', 4)} AS upper
    FROM pred""", "pred")
def confidence_interval(spark, sf):
    return rounded(diag.with_interval(v.pred(spark, sf)).select(*v.PRED_KEYS, "lower", "upper"), 4)


@query("iqr_outliers", f"""
    WITH e AS (SELECT *, abs(truth - mu) AS abs_error FROM pred),
    q AS (SELECT quantile_cont(abs_error, 0.25) AS q1, quantile_cont(abs_error, 0.75) AS q3 FROM e)
    SELECT {_K}, {r('abs_error', 4)} AS abs_error, {r('q1 - 1.5 * (q3 - q1)', 4)} AS lower_fence,
           {r('q3 + 1.5 * (q3 - q1)', 4)} AS upper_fence
    FROM e, q WHERE abs_error < q1 - 1.5 * (q3 - q1) OR abs_error > q3 + 1.5 * (q3 - q1)""", "pred")
def iqr_outliers(spark, sf):
    errors = diag.with_errors(v.pred(spark, sf))
    return rounded(diag.iqr_outliers(errors, "abs_error").select(
        *v.PRED_KEYS, "abs_error", "lower_fence", "upper_fence"), 4)


@query("pit_flag", f"SELECT {_K}, CAST(mu <= truth AS DOUBLE) AS pit_flag FROM pred", "pred")
def pit_flag(spark, sf):
    return diag.pit_flag(v.pred(spark, sf)).select(*v.PRED_KEYS, "pit_flag")


# Normal CDF as its all-positive series: 1/2 + density * sum of z^(2n+1) / (1 3 5 ... (2n+1)).
_PIT = f"""
    WITH z AS (SELECT {_K}, (truth - mu) / 1e4 / sqrt(nullif(alea + epis, 0)) AS z FROM pred),
    c AS (SELECT n, lgamma(2 * n + 2) - n * ln(2) - lgamma(n + 1) AS c FROM range(120) AS o(n)),
    s AS (SELECT {_K}, CASE WHEN z = 0 THEN 0.5 ELSE 0.5 + sign(z) * exp(-z * z / 2) / sqrt(2 * pi())
              * (SELECT sum(exp((2 * n + 1) * ln(nullif(abs(z), 0)) - c)) FROM c) END AS pit FROM z)"""


@query("pit", f"{_PIT} SELECT {_K}, {r('pit')} AS pit FROM s", "pred")
def pit(spark, sf):
    """Errors in units of the truth's spread, so that PIT values cover [0, 1]."""
    scaled = v.pred(spark, sf).withColumns({"truth": F.col("truth") / 1e4, "mu": F.col("mu") / 1e4})
    return rounded(diag.pit(scaled).select(*v.PRED_KEYS, "pit"))


@query("pit_histogram", f"""{_PIT},
    t AS (SELECT count(*) AS total FROM s WHERE pit IS NOT NULL),
    b AS (SELECT least(19, CAST(floor(pit * 20) AS INTEGER)) AS bin, count(*) AS n FROM s WHERE pit IS NOT NULL GROUP BY 1)
    SELECT CAST(o.i AS INTEGER) AS bin, coalesce(n, 0) AS n, {r('coalesce(n, 0) * 20 / total')} AS density
    FROM range(20) AS o(i) CROSS JOIN t LEFT JOIN b ON b.bin = o.i""", "pred")
def pit_histogram(spark, sf):
    scaled = v.pred(spark, sf).withColumns({"truth": F.col("truth") / 1e4, "mu": F.col("mu") / 1e4})
    return rounded(diag.pit_histogram(scaled))


@query("slice_compare", "\nUNION ALL ".join(
    f"SELECT '{name}' AS source, " + ", ".join(
        f"{r(f'avg({c}) FILTER (WHERE s = ' + repr(s) + ')', 4)} AS \"{s}\"" for s in cal.SEASONS) + " FROM ps"
    for name, c in (("truth", "truth"), ("emulator", "mu"))).join(
        [f"WITH ps AS (SELECT *, {_PRED_SEASON} AS s FROM pred)\n", ""]), "pred")
def slice_compare(spark, sf):
    return rounded(diag.slice_compare(cal_slices(v.pred(spark, sf)), "slice", cal.SEASONS), 4)


@query("slice_uncertainty", "\nUNION ALL ".join(
    f"SELECT month, '{m}' AS measure, {r(f'avg({m})')} AS mean FROM pred GROUP BY 1" for m in ("alea", "epis")), "pred")
def slice_uncertainty(spark, sf):
    return rounded(diag.slice_uncertainty(v.pred(spark, sf), ["month"]))
