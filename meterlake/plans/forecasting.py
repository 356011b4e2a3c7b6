"""Registered forecasting queries (J1-J9, C6, C9, D3, G1, G2) over the six
part-type series of ``lineitem`` (daily kWh of ``l_quantity`` readings).

The requested range is the whole table's date span, so series that start
late or end early get NULL days at their ends (filled by J1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlake.operators import filters
from meterlake.operators import forecast as fc
from meterlake.operators.resample import daily_energy
from meterlake.plans.catalog import SERIES6, gapfilled_sql, query
from meterlake.sources import fixtures as fx
from meterlake.sources.tables import read_table

KEYS = ["series"]
HORIZON = 14


def _range(spark, sf):
    li = read_table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("d"))
    return li.select(F.min("d")).scalar(), li.select(F.max("d")).scalar()


def _chain(spark, sf):
    """The chain's outputs of this run; the parts that several of them read are checkpointed files."""
    start, end = _range(spark, sf)
    return fc.run_forecasts(fx.series6(spark, sf), KEYS, HORIZON, start=start, end=end)


_RANGE_SQL = "(select min(cast(l_shipdate as date)) as lo, max(cast(l_shipdate as date)) as hi from lineitem)"
_DAILY_SPAN = gapfilled_sql(SERIES6, KEYS, "cast(ts as date)", "day", "sum(kw) / 60.0", "interval 1 day",
                            out="y", btype="date")
_COMPLETED = f"""with d as ({_DAILY_SPAN}), r as {_RANGE_SQL},
s as (select distinct series from d),
cal as (select series, cast(unnest(generate_series(r.lo, r.hi, interval 1 day)) as date) as ds from s, r),
c as (select cal.series, cal.ds, d.y from cal left join d on d.series = cal.series and d.day = cal.ds)"""


def _fill_sql(src_cte: str) -> str:
    return f"""{src_cte},
k as (select *, date_diff('day', date '1970-01-01', ds) as p, case when y is not null then date_diff('day', date '1970-01-01', ds) end as kp from c),
w as (select *,
  last_value(kp ignore nulls) over (partition by series order by ds rows between unbounded preceding and current row) as pp,
  last_value(y ignore nulls) over (partition by series order by ds rows between unbounded preceding and current row) as pv,
  first_value(kp ignore nulls) over (partition by series order by ds rows between current row and unbounded following) as np_,
  first_value(y ignore nulls) over (partition by series order by ds rows between current row and unbounded following) as nv
  from k),
f as (select series, ds, coalesce(y, pv + (nv - pv) * (p - pp) / nullif(cast(np_ - pp as double), 0), pv, nv, 0) as y from w)"""


_NULL_GAPS = gapfilled_sql(SERIES6, KEYS, "cast(ts as date)", "day", "sum(kw) / 60.0", "interval 1 day",
                           out="y", fill=None, btype="date")


@query("j01_fill_series", _fill_sql(f"with c0 as ({_NULL_GAPS}), c as (select series, day as ds, y from c0)")
       + " select series, ds, y from f")
def j01(spark, sf):
    """Linear fill of the empty days of each daily series (interior gaps
    kept NULL by the roll-up, ends by value carry)."""
    daily = fc.prepare_daily(fx.series6(spark, sf), KEYS, gap_fill="null")
    return fc.fill_series(daily, KEYS)


@query("j02_forecast_gate", _fill_sql(_COMPLETED) + f""", r2 as {_RANGE_SQL}
select series, count(*) as n_days, max(ds) as last_ds, count(*) >= 30 as enough_days,
  max(ds) = (select hi from r2) as ends_at_end from f group by series""")
def j02(spark, sf):
    """Per series day count, >= 30 days gate and the ends-at-end flag."""
    start, end = _range(spark, sf)
    daily = fc.prepare_daily(fx.series6(spark, sf), KEYS, start=start, end=end)
    return fc.forecast_gate(fc.fill_series(daily, KEYS), KEYS, end)


@query("j03_holdout_split", _fill_sql(_COMPLETED) + """,
n as (select series, count(*) as n_days, least(14, count(*) // 2) as holdout, min(ds) as first_ds from f group by series)
select f.series, f.ds, f.y, n.n_days, cast(n.holdout as integer) as holdout,
  date_diff('day', n.first_ds, f.ds) < n.n_days - n.holdout as is_train
from f join n using (series)""")
def j03(spark, sf):
    """The last min(14, n // 2) days of each series held out."""
    start, end = _range(spark, sf)
    daily = fc.prepare_daily(fx.series6(spark, sf), KEYS, start=start, end=end)
    return fc.holdout_split(fc.fill_series(daily, KEYS), KEYS)


@query("c06_zoom", _fill_sql(_COMPLETED) + " select series, ds, y from f where ds between date '1998-01-01' and date '1998-06-30'")
def c06(spark, sf):
    """The filled daily series zoomed to 1998-01-01 .. 1998-06-30."""
    start, end = _range(spark, sf)
    daily = fc.prepare_daily(fx.series6(spark, sf), KEYS, start=start, end=end)
    return filters.zoom(fc.fill_series(daily, KEYS), "1998-01-01", "1998-06-30")


@query("j04_forecast_additive")
def j04(spark, sf):
    """Additive trend + yearly + weekly model of every series, over
    history and hold-out + 14 days, with its 80 % band."""
    return _chain(spark, sf)["model_a"]


@query("j05_forecast_arima")
def j05(spark, sf):
    """ARIMA(5,1,0) forecast of every series for hold-out + 14 days,
    with its 95 % interval."""
    return _chain(spark, sf)["arima"]


@query("g01_union_history_forecast")
def g01(spark, sf):
    """G1: training history (yhat = y) united with the AR forecast."""
    return _chain(spark, sf)["model_b"]


@query("d03_join_actual_and_models")
def d03(spark, sf):
    """D3: validation days joined to both models, incomplete rows dropped."""
    return _chain(spark, sf)["joined"]


@query("j06_evaluate_forecasts")
def j06(spark, sf):
    """MAE and RMSE of both models per series."""
    return _chain(spark, sf)["metrics"].drop("verdict")


@query("j07_model_verdict")
def j07(spark, sf):
    """The better model per series (both errors lower), or mixed."""
    return _chain(spark, sf)["metrics"].select(*KEYS, "verdict")


@query("g02_union_plot_frame")
def g02(spark, sf):
    """Actual values and both models in one long frame."""
    return _chain(spark, sf)["plot"]


@query("c09_after_history")
def c09(spark, sf):
    """Forecast rows dated after each series' last actual day."""
    ch = _chain(spark, sf)
    return filters.after_history(ch["plot"].where(F.col("type") != "Historical"), ch["filled"], KEYS)


@query("j08_forecast_summary")
def j08(spark, sf):
    """Mean and sum of the future predictions per model and series."""
    return _chain(spark, sf)["summary"]


@query("j09_forecast_any_series")
def j09(spark, sf):
    """The whole chain (roll-up, calendar, fill, gate, split, both
    models, scoring, verdict) for every series in one job."""
    ch = _chain(spark, sf)
    return ch["gate"].join(ch["metrics"], KEYS, "left")


# ---- The same operators on a forecast that SQL can express: the value of some days before. -------------------------------------

HOLDOUT_DAYS = 30
_SHIFTED = f"""h as (select series, day as ds, y from ({_DAILY_SPAN})),
a as (select series, cast(ds + interval 7 day as date) as ds, y as yhat from h),
b as (select series, cast(ds + interval 14 day as date) as ds, y as yhat from h),
last as (select series, max(ds) as last_ds from h group by 1)"""


def _shifted(spark, sf):
    """Daily actual values of each series, and two models that repeat the value of 7 and of 14 days before."""
    actual = daily_energy(fx.series6(spark, sf), "kw", keys=KEYS, out_names=["y"]).withColumnRenamed("day", "ds")

    def model(days: int):
        y = F.col("y")
        return actual.select(*KEYS, F.date_add("ds", days).alias("ds"), y.alias("yhat"), y.alias("yhat_lower"), y.alias("yhat_upper"))

    return actual, model(7), model(14)


@query("c09s_after_history", f"""with {_SHIFTED}
select b.series, ds, yhat, yhat as yhat_lower, yhat as yhat_upper from b join last using (series) where ds > last_ds""")
def c09s(spark, sf):
    """The days of a 14-day shift that lie after each series' last actual day."""
    actual, _, b = _shifted(spark, sf)
    return filters.after_history(b, actual, KEYS)


@query("g01s_union_history_forecast", f"""with {_SHIFTED}
select series, ds, y as yhat, y as yhat_lower, y as yhat_upper from h
union all select series, ds, yhat, yhat, yhat from b""")
def g01s(spark, sf):
    """G1: history followed by the shifted forecast."""
    actual, _, b = _shifted(spark, sf)
    return fc.union_history_forecast(actual, b, KEYS)


_PLOT_SQL = f"""select series, ds, y, cast(null as double) as yhat_lower, cast(null as double) as yhat_upper, 'Historical' as type from h
union all select series, ds, yhat, yhat, yhat, '{fc.MODEL_A}' from a union all select series, ds, yhat, yhat, yhat, '{fc.MODEL_B}' from b"""


@query("g02s_union_plot_frame", f"with {_SHIFTED} {_PLOT_SQL}")
def g02s(spark, sf):
    """Actual values and both shifted models in one long frame."""
    return fc.union_plot_frame(*_shifted(spark, sf), KEYS)


def _joined_sql(first: str) -> str:
    return f"""j as (select h.series, h.ds, h.y, a.yhat as yhat_a, b.yhat as yhat_b from h join last using (series)
  join a on a.series = h.series and a.ds = h.ds join b on b.series = h.series and b.ds = h.ds where h.ds >= {first})"""


_REFERENCE = f"cast(last_ds - interval {HOLDOUT_DAYS} day as date)"
_STRICT = f"cast(last_ds - interval {HOLDOUT_DAYS - 1} day as date)"
_METRICS_SQL = """m as (select series, avg(abs(yhat_a - y)) as mae_a, sqrt(avg((yhat_a - y) * (yhat_a - y))) as rmse_a,
  avg(abs(yhat_b - y)) as mae_b, sqrt(avg((yhat_b - y) * (yhat_b - y))) as rmse_b, count(*) as n_val from j group by 1)"""


def _shifted_join(spark, sf, window: str = "reference"):
    actual, a, b = _shifted(spark, sf)
    holdout = actual.select(*KEYS).distinct().withColumn("holdout", F.lit(HOLDOUT_DAYS))
    return fc.join_actual_and_models(actual, a, b, holdout, KEYS, window=window)


@query("d03s_join_actual_and_models", f"with {_SHIFTED}, {_joined_sql(_REFERENCE)} select * from j")
def d03s(spark, sf):
    """D3: the validation days (one training day included) joined to both shifted models."""
    return _shifted_join(spark, sf)


@query("j06s_evaluate_forecasts_strict", f"with {_SHIFTED}, {_joined_sql(_STRICT)}, {_METRICS_SQL} select * from m")
def j06s(spark, sf):
    """MAE and RMSE of both shifted models on the held-out days alone."""
    return fc.evaluate_forecasts(_shifted_join(spark, sf, "strict"), KEYS)


@query("j07s_model_verdict", f"""with {_SHIFTED}, {_joined_sql(_REFERENCE)}, {_METRICS_SQL}
select *, case when mae_a is null or rmse_a is null or mae_b is null or rmse_b is null then 'insufficient data'
  when mae_a < mae_b and rmse_a < rmse_b then '{fc.MODEL_A} better' when mae_b < mae_a and rmse_b < rmse_a then '{fc.MODEL_B} better'
  else 'mixed' end as verdict from m""")
def j07s(spark, sf):
    """Errors of both shifted models and the verdict per series."""
    return fc.model_verdict(fc.evaluate_forecasts(_shifted_join(spark, sf), KEYS))


@query("j08s_forecast_summary", f"""with {_SHIFTED}, p as ({_PLOT_SQL})
select series, type, avg(y) as mean_yhat, sum(y) as sum_yhat, count(*) as n_days
from p join last using (series) where type <> 'Historical' and ds > last_ds group by all""")
def j08s(spark, sf):
    """Mean and sum of the shifted models' future days."""
    actual, a, b = _shifted(spark, sf)
    return fc.forecast_summary(fc.union_plot_frame(actual, a, b, KEYS), actual, KEYS)
