"""Forecasting many daily series at once (J1-J9, with C9, D3, G1, G2).

Shape of the work:

* preparation (daily roll-up, calendar, fill, gates, hold-out) is Spark SQL
  grouped by series key; every per-series window runs over one series' days,
  a size bounded by the calendar span, never by the number of readings;
* the AR model sees one row per series (its days as an array, bounded by the
  calendar) and fits batches of series together by exact maximum likelihood;
  the additive model's design matrix is a Spark expression and its sparse fit runs
  per series on that series' training days (bounded by the calendar span);
* predictions are DataFrame projections.

Known deviation (stated in the README): the additive model is fitted from sums of a
Prophet-style design (piecewise-linear trend, yearly and weekly Fourier
terms) by coordinate descent, and its band is in closed form, not by simulation.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.operators import autoregression, resample
from meterlake.operators._util import col, join_scalar_keys, keys_list, null_safe_join

# Fixed values taken from the source's settings.
MIN_DAYS = 30            # fewer days: no forecast
HOLDOUT_MAX = 14         # hold-out = min(14, n // 2) days
AR_ORDER = 5             # ARIMA(5, 1, 0)
Z_95 = 1.959963984540054  # 95 % interval of the AR model
Z_80 = 1.2815515655446004  # 80 % band of the additive model
N_CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8
YEARLY_ORDER, YEARLY_PERIOD = 10, 365.25
WEEKLY_ORDER, WEEKLY_PERIOD = 3, 7.0
CHANGE_PRIOR = 0.05      # scale of the slope changes' Laplace prior
SWEEPS = 2_000           # of the coordinate descent, at most
SERIES_TOGETHER = 256    # series whose likelihood is searched together
MODEL_A, MODEL_B = "additive", "arima"


def _w(keys, *order) -> Window:
    return (Window.partitionBy(*keys) if keys else Window).orderBy(*order)


# ---------------------------------------------------------------- J1 - J3

def prepare_daily(raw: DataFrame, keys, value_col: str = "kw", ts_col: str = "ts",
                  start=None, end=None, gap_fill: str = "zero") -> DataFrame:
    """Daily series ``(keys, ds, y)``; with ``start``/``end`` completed over
    that range (D2) so days outside a series' span are NULL."""
    k = keys_list(keys)
    daily = resample.daily_energy(raw, value_col, keys=k, ts_col=ts_col, gap_fill=gap_fill, out_names=["y"])
    daily = daily.withColumnRenamed("day", "ds")
    if start is not None and end is not None:
        daily = resample.complete_calendar(daily, start, end, keys=k)
    return daily


def fill_series(series: DataFrame, keys=None, ds_col: str = "ds", y_col: str = "y") -> DataFrame:
    """Linear interpolation between known days; a trailing gap takes the
    last value, a leading gap the first, an all-NULL series 0."""
    k = keys_list(keys)
    pos = F.datediff(F.col(ds_col), F.lit("1970-01-01").cast("date"))
    known = F.when(F.col(y_col).isNotNull(), F.struct(pos.alias("p"), F.col(y_col).alias("v")))
    d = series.withColumn("_k", known)
    d = d.withColumn("_prev", F.last("_k", ignorenulls=True).over(
        _w(k, F.col(ds_col)).rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("_next", F.last("_k", ignorenulls=True).over(
        _w(k, F.desc(ds_col)).rowsBetween(Window.unboundedPreceding, 0)))
    span = (F.col("_next.p") - F.col("_prev.p")).cast("double")
    interp = F.col("_prev.v") + (F.col("_next.v") - F.col("_prev.v")) * (pos - F.col("_prev.p")) / F.nullif(span, F.lit(0.0))
    y = F.coalesce(F.col(y_col), interp, F.col("_prev.v"), F.col("_next.v"), F.lit(0.0))
    return d.withColumn(y_col, y).drop("_k", "_prev", "_next")


def forecast_gate(series: DataFrame, keys=None, end=None, ds_col: str = "ds", min_days: int = MIN_DAYS) -> DataFrame:
    """Per series the day count, whether it is enough (>= 30) and whether
    the last day is the requested end (else a warning flag)."""
    k = keys_list(keys)
    g = (series.groupBy(*k) if k else series).agg(F.count(F.lit(1)).alias("n_days"), F.max(ds_col).alias("last_ds"))
    end_c = F.col("last_ds") if end is None else (end if isinstance(end, Column) else F.lit(end).cast("date"))
    return g.withColumns({"enough_days": F.col("n_days") >= min_days,
                          "ends_at_end": F.col("last_ds") == end_c})


def holdout_split(series: DataFrame, keys=None, ds_col: str = "ds", holdout_max: int = HOLDOUT_MAX) -> DataFrame:
    """v = min(14, n // 2) last days are held out; ``is_train`` marks
    the rest. Series are complete daily calendars, so a row's index is its
    day offset: no window needed."""
    k = keys_list(keys)
    st = (series.groupBy(*k) if k else series).agg(
        F.count(F.lit(1)).alias("n_days"), F.min(ds_col).alias("_first"))
    st = st.withColumn("holdout", F.least(F.lit(holdout_max), F.floor(F.col("n_days") / 2)).cast("int"))
    d = join_scalar_keys(series, st, k)
    idx = F.datediff(F.col(ds_col), F.col("_first"))
    return d.withColumn("is_train", idx < F.col("n_days") - F.col("holdout")).drop("_first")


# ---------------------------------------------------------------- J5: AR

TOO_SHORT = "too few days"


def _ar_batches(keys: int, p: int):
    """One row a series (keys, days, last day, steps) to its fit and its forecasts; series of one length are fitted together."""

    def run(batches):
        for batch in batches:
            columns = batch.columns
            days = [np.array(v, float) for v in columns[keys].to_pylist()]
            steps = np.asarray(columns[keys + 2]).astype(int)
            fits: dict[int, tuple] = {}
            by_length: dict[int, list[int]] = {}
            for i, y in enumerate(days):
                by_length.setdefault(len(y), []).append(i)
            for n, own in by_length.items():
                if n < p + 3:  # p + 2 differences
                    continue
                for at in range(0, len(own), SERIES_TOGETHER):
                    part = own[at : at + SERIES_TOGETHER]
                    levels = np.stack([days[i] for i in part])
                    d = np.diff(levels, axis=1)
                    phi, sigma2, loglik = autoregression.fit(d, p)
                    most = int(steps[part].max())
                    spread = np.sqrt(sigma2[:, None] * np.cumsum(autoregression.interval_weights(phi, most) ** 2, 1))
                    last, level = d[:, ::-1][:, :p].copy(), levels[:, -1]
                    ahead = np.empty((len(part), most))
                    for h in range(most):
                        now = (phi * last).sum(1)
                        last = np.concatenate([now[:, None], last[:, :-1]], 1)
                        level = level + now
                        ahead[:, h] = level
                    for k, i in enumerate(part):
                        fits[i] = phi[k], sigma2[k], loglik[k], ahead[k], Z_95 * spread[k]
            out = {name: [] for name in ("n_days", "phi", "sigma2", "log_likelihood", "reason", "forecast")}
            for i, y in enumerate(days):
                phi, sigma2, loglik, ahead, half = fits.get(i, (None, None, None, [], []))
                out["n_days"].append(len(y))
                out["phi"].append(None if phi is None else phi.tolist())
                out["sigma2"].append(sigma2)
                out["log_likelihood"].append(None if loglik is None or math.isnan(loglik) else loglik)
                out["reason"].append(TOO_SHORT if phi is None else None)
                out["forecast"].append([{"step": h + 1, "yhat": v, "yhat_lower": v - w, "yhat_upper": v + w} for h, (v, w) in enumerate(zip(ahead[: steps[i]], half, strict=False))])
            step = pa.struct([("step", pa.int32()), ("yhat", pa.float64()), ("yhat_lower", pa.float64()), ("yhat_upper", pa.float64())])
            kinds = (pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.string(), pa.list_(step))
            made = [pa.array(out[c], t) for c, t in zip(out, kinds, strict=True)]
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([*columns[:keys], columns[keys + 1], *made], [*names[:keys], "last_ds", *out])

    return run


def fit_arima(train: DataFrame, steps: DataFrame, keys=None, ds_col: str = "ds", y_col: str = "y", p: int = AR_ORDER) -> DataFrame:
    """ARIMA(p, 1, 0) without constant of every series, by exact maximum likelihood: one row a series with ``last_ds, n_days, phi, sigma2,
    log_likelihood``, the ``forecast`` of its ``_steps`` days after the last one (``steps``: keys + ``_steps``), and the ``reason`` why there is none.

    A series' days are one array, bounded by the calendar; days without a value count as gaps."""
    k = keys_list(keys)
    days = F.transform(F.array_sort(F.collect_list(F.struct(col(ds_col).alias("d"), F.coalesce(col(y_col).cast("double"), F.lit(float("nan"))).alias("y")))), lambda r: r["y"])
    rows = train.where(col(ds_col).isNotNull())
    rows = (rows.groupBy(*k) if k else rows.groupBy(F.lit(1).alias("_one"))).agg(days.alias("_days"), F.max(ds_col).alias("last_ds")).select(*k, "_days", "last_ds")
    rows = join_scalar_keys(rows, steps, k).select(*k, "_days", "last_ds", F.coalesce("_steps", F.lit(0)).alias("_steps"))
    forecast = "array<struct<step: int, yhat: double, yhat_lower: double, yhat_upper: double>>"
    fields = [T.StructField(c, rows.schema[c].dataType, True) for c in (*k, "last_ds")]
    schema = T.StructType([*fields, T.StructField("n_days", T.LongType()), T.StructField("phi", T.ArrayType(T.DoubleType())), T.StructField("sigma2", T.DoubleType()),
                           T.StructField("log_likelihood", T.DoubleType()), T.StructField("reason", T.StringType()), T.StructField("forecast", T._parse_datatype_string(forecast))])
    return rows.mapInArrow(_ar_batches(len(k), p), schema)


def forecast_arima(train: DataFrame, steps: DataFrame, keys=None, ds_col: str = "ds", y_col: str = "y",
                   p: int = AR_ORDER) -> DataFrame:
    """The forecasts of ``fit_arima`` with the 95 % interval from the psi weights, one row a day. Series that are too short have none; ``fit_arima``
    names them and the reason."""
    k = keys_list(keys)
    out = fit_arima(train, steps, k, ds_col, y_col, p).select(*k, "last_ds", F.explode("forecast").alias("f"))
    return out.select(*k, F.date_add("last_ds", F.col("f.step")).alias(ds_col), "f.yhat", "f.yhat_lower", "f.yhat_upper")


# ------------------------------------------------------ J4: additive model

def _design(ds: Column, t: Column, cps: Column) -> Column:
    """Feature vector: 1, t, hinge(t - s_k) for the changepoints, yearly and
    weekly Fourier terms on days since 1970-01-01."""
    day = F.datediff(ds, F.lit("1970-01-01").cast("date")).cast("double")
    feats = [F.lit(1.0), t]
    hinges = F.transform(cps, lambda s: F.greatest(t - s, F.lit(0.0)))
    four = []
    for order, period in ((YEARLY_ORDER, YEARLY_PERIOD), (WEEKLY_ORDER, WEEKLY_PERIOD)):
        for j in range(1, order + 1):
            ang = day * (2.0 * math.pi * j / period)
            four += [F.sin(ang), F.cos(ang)]
    return F.concat(F.array(*feats), hinges, F.array(*four))


def _n_features() -> int:
    return 2 + N_CHANGEPOINTS + 2 * (YEARLY_ORDER + WEEKLY_ORDER)


def _sparse_fit(keys: list[str], kdim: int, prior: float, lam_season: float):
    """Per series: X'X and X'y of its training days, and the fit with an absolute penalty on the slope changes. One group is one
    series' training days, so its size is bounded by the calendar span."""
    import pandas as pd

    changes = slice(2, 2 + N_CHANGEPOINTS)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = np.stack(pdf["_f"].to_numpy()), pdf["_ys"].to_numpy(dtype=float)
        beta, sigma = sparse_coefficients(x.T @ x, x.T @ y, float(y @ y), len(y), changes, prior, lam_season)
        out = pdf[keys].iloc[:1].copy()
        out["_beta"] = [beta.tolist()]
        out["_jump"] = float(np.abs(beta[changes]).mean())
        return out
    return fit


def _with_signs(g, b, delta, penalty: float):
    """The minimum if it has just the signs of ``delta``, else None: then it follows from one linear system."""
    own = delta != 0
    out = np.zeros(len(b))
    if own.any():
        try:
            out[own] = np.linalg.solve(g[np.ix_(own, own)], b[own] - penalty * np.sign(delta[own]))
        except np.linalg.LinAlgError:
            return None
    fits = (np.sign(out) == np.sign(delta)).all() and (np.abs(b - g @ out)[~own] <= penalty * (1 + 1e-9)).all()
    return out if fits else None


def sparse_coefficients(gram, xy, yy: float, n: int, changes: slice, prior: float, lam_season: float, rounds: int = 4) -> tuple:
    """Coefficients that minimise ||y - X b||^2 / (2 s^2) + sum |slope changes| / prior + a small square penalty on the seasons, and s, the residuals' spread,
    which is settled in turn. Changes are cyclic coordinate descent on the sums alone; everything else is solved for exactly beforehand."""
    k = len(xy)
    change = np.zeros(k, bool)
    change[changes] = True
    square = np.where(np.arange(k) >= changes.stop, lam_season, 1e-9)
    rest = ~change
    inner = gram[np.ix_(rest, rest)] + np.diag(square[rest])
    # The changes' sums with the other features taken out.
    out = np.linalg.lstsq(inner, np.concatenate([gram[np.ix_(rest, change)], xy[rest, None]], 1), rcond=None)[0]
    g = gram[np.ix_(change, change)] - gram[np.ix_(change, rest)] @ out[:, :-1]
    b = xy[change] - gram[np.ix_(change, rest)] @ out[:, -1]
    sigma = max(math.sqrt(max(yy - xy[rest] @ out[:, -1], 0.0) / n), 1e-6)
    delta = np.zeros(len(b))
    for _ in range(rounds):
        penalty = sigma * sigma / prior
        slack = b - g @ delta
        for _sweep in range(SWEEPS):
            most = 0.0
            for j in range(len(b)):
                if g[j, j] <= 1e-12:
                    continue
                z = slack[j] + g[j, j] * delta[j]
                new = math.copysign(max(abs(z) - penalty, 0.0), z) / g[j, j]
                if new != delta[j]:
                    slack -= g[:, j] * (new - delta[j])
                    most = max(most, abs(new - delta[j]) * g[j, j])
                    delta[j] = new
            if most <= 1e-9 * max(penalty, 1e-12):
                break
            if _sweep % 10 == 9 and (exact := _with_signs(g, b, delta, penalty)) is not None:
                delta = exact
                break
        beta = np.zeros(k)
        beta[change] = delta
        beta[rest] = out[:, -1] - out[:, :-1] @ delta
        sigma, before = max(math.sqrt(max(yy - 2 * xy @ beta + beta @ gram @ beta, 0.0) / n), 1e-6), sigma
        if abs(sigma - before) <= 1e-6 * before:
            break
    return beta, sigma


def forecast_additive(split: DataFrame, steps: DataFrame, keys=None, ds_col: str = "ds", y_col: str = "y",
                      prior: float = CHANGE_PRIOR, lam_season: float = 0.01) -> DataFrame:
    """Additive trend + yearly + weekly model fitted on the training days
    of every series, predicted over history and ``steps`` future days.

    Few slope changes are not zero: their absolute sum is penalised (a Laplace prior of scale ``prior``). The 80 % band is +-z times the spread of
    the residuals and, in the future, of slope changes to come: these are as frequent and as large on average as the fitted ones, so u
    training spans ahead the trend's variance is N_CHANGEPOINTS * 2 * (mean size)^2 * u^3 / 3."""
    k = keys_list(keys)
    train = split.where("is_train")
    st = (train.groupBy(*k) if k else train).agg(
        F.min(ds_col).alias("_t0"), F.max(ds_col).alias("_t1"), F.count(F.lit(1)).alias("_nt"),
        F.max(F.abs(F.col(y_col))).alias("_ymax"))
    st = join_scalar_keys(st, steps, k)
    # Changepoints at evenly spaced positions of the first 80 % of the
    # training days, as fractions of the training span.
    hist = F.floor(F.col("_nt") * CHANGEPOINT_RANGE)
    span = F.greatest(F.col("_nt") - 1, F.lit(1)).cast("double")
    cps = F.transform(F.sequence(F.lit(1), F.lit(N_CHANGEPOINTS)),
                      lambda i: F.round((hist - 1) * i / N_CHANGEPOINTS) / span)
    st = st.withColumn("_cps", cps).withColumn("_scale", F.when(F.col("_ymax") > 0, F.col("_ymax")).otherwise(F.lit(1.0)))
    future = st.select(*k, F.explode(F.sequence(F.lit(1), F.col("_steps"))).alias("_h"), "_t1") \
        .select(*k, F.date_add("_t1", F.col("_h")).alias(ds_col))
    frame = train.select(*k, ds_col, y_col).unionByName(future.withColumn(y_col, F.lit(None).cast("double")))
    frame = join_scalar_keys(frame, st.select(*k, "_t0", "_cps", "_scale", "_nt"), k)
    t = F.datediff(F.col(ds_col), F.col("_t0")).cast("double") / F.greatest(F.col("_nt") - 1, F.lit(1)).cast("double")
    frame = frame.withColumn("_f", _design(F.col(ds_col), t, F.col("_cps"))) \
        .withColumn("_ahead", F.greatest(t - 1, F.lit(0.0))).withColumn("_ys", F.col(y_col) / F.col("_scale"))
    kdim = _n_features()
    key_fields = [f for f in split.schema.fields if f.name in k]
    own = [T.StructField("_beta", T.ArrayType(T.DoubleType())), T.StructField("_jump", T.DoubleType())]
    bschema = T.StructType(key_fields + own)
    fit_rows = frame.where(F.col("_ys").isNotNull()).select(*k, "_f", "_ys")
    if k:
        beta = fit_rows.groupBy(*k).applyInPandas(_sparse_fit(k, kdim, prior, lam_season), bschema)
    else:
        beta = fit_rows.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(
            _sparse_fit([], kdim, prior, lam_season), T.StructType(own))
    pred = join_scalar_keys(frame, beta, k)
    dot = F.aggregate(F.zip_with("_f", "_beta", lambda x, b: x * b), F.lit(0.0), lambda acc, x: acc + x)
    pred = pred.withColumn("yhat", dot * F.col("_scale"))
    resid = (pred.where(F.col(y_col).isNotNull()).groupBy(*k) if k else pred.where(F.col(y_col).isNotNull())) \
        .agg(F.sqrt(F.avg((F.col(y_col) - F.col("yhat")) ** 2)).alias("_sigma"))
    pred = join_scalar_keys(pred, resid, k)
    trend = F.col("_scale") * F.col("_jump")
    half = F.lit(Z_80) * F.sqrt(F.col("_sigma") ** 2 + 2 * N_CHANGEPOINTS / 3 * trend * trend * F.pow("_ahead", F.lit(3.0)))
    return pred.select(*k, ds_col, "yhat", (F.col("yhat") - half).alias("yhat_lower"),
                       (F.col("yhat") + half).alias("yhat_upper"))


# ------------------------------------------------- J6 - J8, C9, D3, G1, G2

def history_frame(train: DataFrame, keys=None, ds_col: str = "ds", y_col: str = "y") -> DataFrame:
    """History rows in forecast shape: yhat = lower = upper = y."""
    k = keys_list(keys)
    return train.select(*k, ds_col, F.col(y_col).alias("yhat"), F.col(y_col).alias("yhat_lower"),
                        F.col(y_col).alias("yhat_upper"))


def union_history_forecast(train: DataFrame, forecast: DataFrame, keys=None, ds_col: str = "ds") -> DataFrame:
    """G1: history (yhat = y) followed by the forecast rows."""
    k = keys_list(keys)
    return history_frame(train, k, ds_col).unionByName(forecast.select(*k, ds_col, "yhat", "yhat_lower", "yhat_upper"))


def union_plot_frame(actual: DataFrame, model_a: DataFrame, model_b: DataFrame, keys=None,
                     ds_col: str = "ds", y_col: str = "y") -> DataFrame:
    """Actual values and both models in one long frame tagged by type."""
    k = keys_list(keys)
    hist = actual.select(*k, ds_col, y_col).withColumn("type", F.lit("Historical"))
    a = model_a.select(*k, ds_col, F.col("yhat").alias(y_col), "yhat_lower", "yhat_upper").withColumn("type", F.lit(MODEL_A))
    b = model_b.select(*k, ds_col, F.col("yhat").alias(y_col), "yhat_lower", "yhat_upper").withColumn("type", F.lit(MODEL_B))
    return hist.unionByName(a, allowMissingColumns=True).unionByName(b, allowMissingColumns=True)


def join_actual_and_models(actual: DataFrame, model_a: DataFrame, model_b: DataFrame, holdout: DataFrame,
                           keys=None, ds_col: str = "ds", y_col: str = "y", window: str = "reference") -> DataFrame:
    """D3: validation days joined to both models' predictions on (keys, ds),
    rows without both predictions dropped. ``window="reference"`` keeps the
    v + 1 days from last - v (one of them a training day), ``"strict"`` the
    v held-out days only."""
    k = keys_list(keys)
    last = (actual.groupBy(*k) if k else actual).agg(F.max(ds_col).alias("_last"))
    st = join_scalar_keys(last, holdout, k)
    lo = F.date_sub("_last", F.col("holdout")) if window == "reference" else F.date_sub("_last", F.col("holdout") - 1)
    v = join_scalar_keys(actual.select(*k, ds_col, y_col), st.select(*k, "_last", "holdout"), k) \
        .where(F.col(ds_col) >= lo).drop("_last", "holdout")
    a = model_a.select(*k, ds_col, F.col("yhat").alias("yhat_a"))
    b = model_b.select(*k, ds_col, F.col("yhat").alias("yhat_b"))
    return null_safe_join(null_safe_join(v, a, [*k, ds_col], "left"), b, [*k, ds_col], "left").dropna(subset=[y_col, "yhat_a", "yhat_b"])


def evaluate_forecasts(joined: DataFrame, keys=None, y_col: str = "y") -> DataFrame:
    """MAE and RMSE of both models on the validation rows."""
    k = keys_list(keys)
    ea, eb = F.col("yhat_a") - F.col(y_col), F.col("yhat_b") - F.col(y_col)
    aggs = [F.avg(F.abs(ea)).alias("mae_a"), F.sqrt(F.avg(ea * ea)).alias("rmse_a"),
            F.avg(F.abs(eb)).alias("mae_b"), F.sqrt(F.avg(eb * eb)).alias("rmse_b"),
            F.count(F.lit(1)).alias("n_val")]
    return joined.groupBy(*k).agg(*aggs) if k else joined.agg(*aggs)


def model_verdict(metrics: DataFrame) -> DataFrame:
    """Which model is better (both errors lower), mixed, or not enough data."""
    a_mae, a_rmse, b_mae, b_rmse = (F.col(c) for c in ("mae_a", "rmse_a", "mae_b", "rmse_b"))
    missing = a_mae.isNull() | a_rmse.isNull() | b_mae.isNull() | b_rmse.isNull()
    v = (F.when(missing, F.lit("insufficient data"))
         .when((a_mae < b_mae) & (a_rmse < b_rmse), F.lit(f"{MODEL_A} better"))
         .when((b_mae < a_mae) & (b_rmse < a_rmse), F.lit(f"{MODEL_B} better"))
         .otherwise(F.lit("mixed")))
    return metrics.withColumn("verdict", v)


def forecast_summary(plot: DataFrame, actual: DataFrame, keys=None, ds_col: str = "ds", y_col: str = "y") -> DataFrame:
    """J8 (+C9): mean and sum of the future predictions (after the last actual
    day) per model."""
    from meterlake.operators.filters import after_history
    k = keys_list(keys)
    fut = after_history(plot.where(F.col("type") != "Historical"), actual, k, ds_col)
    return fut.groupBy(*k, "type").agg(F.avg(y_col).alias("mean_yhat"), F.sum(y_col).alias("sum_yhat"),
                                       F.count(F.lit(1)).alias("n_days"))


def run_forecasts(raw: DataFrame, keys, horizon: int = 14, value_col: str = "kw", ts_col: str = "ts",
                  start=None, end=None) -> dict[str, DataFrame]:
    """The whole chain for every series at once.

    The filled daily series and the two model outputs are small (series x
    days) and feed several later steps, so they are checkpointed to the
    shared checkpoint folder: the raw readings are scanned once and a lost
    executor does not replay the whole lineage."""
    from meterlake.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(raw.sparkSession)
    k = keys_list(keys)
    daily = prepare_daily(raw, k, value_col, ts_col, start, end)
    filled = fill_series(daily, k).checkpoint(eager=True)
    gate = forecast_gate(filled, k, end)
    ok = gate.where("enough_days").select(*k)
    filled = null_safe_join(filled, ok, k, "left_semi") if k else filled
    split = holdout_split(filled, k)
    holdout = split.groupBy(*k).agg(F.first("holdout").alias("holdout")) if k else split.agg(F.first("holdout").alias("holdout"))
    steps = holdout.withColumn("_steps", F.col("holdout") + horizon).select(*k, "_steps")
    train = split.where("is_train").select(*k, "ds", "y")
    model_a = forecast_additive(split.select(*k, "ds", "y", "is_train"), steps, k).checkpoint(eager=True)
    arima_fc = forecast_arima(train, steps, k).checkpoint(eager=True)
    model_b = union_history_forecast(train, arima_fc, k)
    joined = join_actual_and_models(filled.select(*k, "ds", "y"), model_a, model_b, holdout, k)
    metrics = model_verdict(evaluate_forecasts(joined, k))
    plot = union_plot_frame(filled, model_a, model_b, k)
    summary = forecast_summary(plot, filled, k)
    return {"daily": daily, "filled": filled, "gate": gate, "split": split, "model_a": model_a,
            "arima": arima_fc, "model_b": model_b, "joined": joined, "metrics": metrics,
            "plot": plot, "summary": summary}
