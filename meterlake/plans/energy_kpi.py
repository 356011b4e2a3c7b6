"""Registered queries for roll-ups, joins, KPIs, top-k, statistics and
sampling (D, E, F, H1-H4, H8, I1) and the flagship day view (M1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlake.functions.weather import weather_group, weather_group_ord
from meterlake.operators import calendar_grid, filters, kpi, resample, stats
from meterlake.operators.sampling import sample_n
from meterlake.plans.catalog import (COVARIATES, DEVICES25, METER_LONG, METER_WIDE, WEATHER_GROUP_SQL,
                                     WEATHER_GROUPS_VALUES, gapfilled_sql, query)
from meterlake.sources import fixtures as fx

H_STEP, D_STEP, M_STEP = "interval 1 hour", "interval 1 day", "interval 1 month"
ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _hourly_site():
    return f"""with w as ({METER_WIDE}),
a as (select date_trunc('hour', ts) as hour, sum(use_kw) / 60.0 as u, sum(gen_kw) / 60.0 as g from w group by all),
cal as (select unnest(generate_series(min(hour), max(hour), interval 1 hour)) as hour from a),
h as (select cal.hour, coalesce(a.u, 0) as use_kwh, coalesce(a.g, 0) as gen_kwh, coalesce(a.u, 0) - coalesce(a.g, 0) as net_kwh
      from cal left join a using (hour))"""


@query("m1_hourly_site_day_view", _hourly_site() + """,
k as (select cast(hour as date) as day, sum(use_kwh) as day_use_total, max(use_kwh) as day_use_peak,
             avg(use_kwh) as day_use_mean, count(*) as day_hours from h group by 1),
p as (select cast(h.hour as date) as day, min(h.hour) as day_use_peak_at from h join k
      on cast(h.hour as date) = k.day and h.use_kwh = k.day_use_peak group by 1)
select h.hour, k.day, use_kwh, gen_kwh, net_kwh, day_use_total, day_use_peak, day_use_peak_at, day_use_mean, day_hours
from h join k on cast(h.hour as date) = k.day join p on p.day = k.day""")
def m1(spark, sf):
    """M1 flagship: hourly use / generation / net of the site (gap-filled),
    each hour carrying its day's KPIs (total, first peak hour, mean)."""
    h = resample.align_use_gen(fx.meter_wide(spark, sf)).withColumn("day", F.to_date("hour"))
    return kpi.attach_kpis(h, "use_kwh", "hour", ["day"], prefix="day_use_").withColumnRenamed(
        "day_use_buckets", "day_hours")


@query("d01_align_use_gen", _hourly_site() + " select hour, use_kwh, gen_kwh from h")
def d01(spark, sf):
    """Hourly use and generation side by side, missing = 0."""
    return resample.align_use_gen(fx.meter_wide(spark, sf)).select("hour", "use_kwh", "gen_kwh")


MS, ME = "2023-12-25", "2024-02-05"
_DEV_DAILY = gapfilled_sql(METER_LONG, ["device"], "cast(ts as date)", "day", "sum(kw) / 60.0", D_STEP,
                           out="y", btype="date")
_COMPLETED = f"""with d as ({_DEV_DAILY}),
devs as (select distinct device from d),
cal as (select device, cast(unnest(generate_series(date '{MS}', date '{ME}', interval 1 day)) as date) as ds from devs)
select cal.device, cal.ds, d.y from cal left join d on d.device = cal.device and d.day = cal.ds"""


def _completed(spark, sf):
    daily = resample.daily_energy(fx.meter_long(spark, sf), "kw", keys=["device"], out_names=["y"])
    return resample.complete_calendar(daily.withColumnRenamed("day", "ds"), MS, ME, keys=["device"])


@query("d02_complete_calendar", _COMPLETED)
def d02(spark, sf):
    """Every day of 2023-12-25..2024-02-05 per device, NULL where no value."""
    return _completed(spark, sf)


@query("e18_missing_report", f"""with c as ({_COMPLETED})
select device, count(*) as n_days, count(*) filter (where y is null) as n_missing,
  count(*) filter (where y is null) * 100.0 / count(*) as missing_pct,
  coalesce(string_agg(strftime(ds, '%d/%m/%Y'), ', ' order by ds) filter (where y is null), '') as missing_dates,
  count(*) filter (where y is null) > count(*) * 0.1 as too_many_missing
from c group by device""")
def e18(spark, sf):
    """Missing days per device over the requested range: count, share,
    list and the >10 % flag."""
    return kpi.missing_report(_completed(spark, sf), keys=["device"])


@query("d04_reindex_dimension", f"""with c as ({COVARIATES}),
n as (select {WEATHER_GROUP_SQL} as weather_group, count(*) as n_rows from c group by 1)
select g.weather_group, g.ord as weather_ord, n.n_rows from {WEATHER_GROUPS_VALUES} left join n using (weather_group)""")
def d04(spark, sf):
    """All 11 weather groups, row counts joined on (NULL when absent)."""
    c = fx.covariates(spark, sf)
    n = c.groupBy(weather_group("summary").alias("weather_group")).agg(F.count(F.lit(1)).alias("n_rows"))
    return F.broadcast(stats._groups_dim(spark)).join(n, "weather_group", "left")


_D25_DAILY = gapfilled_sql(DEVICES25, ["device"], "cast(ts as date)", "day", "sum(kw) / 60.0", D_STEP,
                           btype="date")


_BRANDS = [f"Brand#{i}{j}" for i in range(1, 6) for j in range(1, 6)]


@query("d06_align_devices_daily", f"""with d as ({_D25_DAILY})
select day, {", ".join(f"max(case when device = '{b}' then kwh end) as \"{b}\"" for b in _BRANDS)} from d group by day""")
def d06(spark, sf):
    """The 25 device daily series in one frame, a column per device."""
    return resample.align_devices_daily(fx.devices25(spark, sf), devices=_BRANDS)


@query("e01_daily_energy", gapfilled_sql(METER_LONG, ["device"], "cast(ts as date)", "day", "sum(kw) / 60.0",
                                         D_STEP, btype="date"))
def e01(spark, sf):
    """Daily kWh per device, empty days in the span = 0."""
    return resample.daily_energy(fx.meter_long(spark, sf), "kw", keys=["device"], out_names=["kwh"])


@query("e02_hourly_energy", gapfilled_sql(METER_LONG, ["device"], "date_trunc('hour', ts)", "hour",
                                          "sum(kw) / 60.0", H_STEP))
def e02(spark, sf):
    """Hourly kWh per device, empty hours in the span = 0."""
    return resample.hourly_energy(fx.meter_long(spark, sf), "kw", keys=["device"], out_names=["kwh"])


@query("e03_monthly_energy", f"""select device, last_day(month) as month, kwh from (
{gapfilled_sql(DEVICES25, ["device"], "date_trunc('month', ts)", "month", "sum(kw) / 60.0", M_STEP, btype="date")})""")
def e03(spark, sf):
    """Monthly kWh per device, labelled by month end."""
    return resample.monthly_energy(fx.devices25(spark, sf), "kw", keys=["device"], out_names=["kwh"])


@query("e04_daily_mean", f"""with c as ({COVARIATES}),
a as (select cast(ts as date) as day, avg(use_kw) as use_kw, avg(temperature) as temperature,
      avg(humidity) as humidity, avg(windSpeed) as windSpeed from c group by 1),
cal as (select cast(unnest(generate_series(min(day), max(day), interval 1 day)) as date) as day from a)
select cal.day, a.use_kw, a.temperature, a.humidity, a.windSpeed from cal left join a using (day)""")
def e04(spark, sf):
    """Daily mean of every numeric column; a day without rows is NULL."""
    c = fx.covariates(spark, sf).select("ts", "use_kw", "temperature", "humidity", "windSpeed")
    return resample.daily_mean(c)


@query("e05_monthly_mean", f"""select month(ts) as month, avg(use_kw) as use_kw, avg(temperature) as temperature
from ({COVARIATES}) group by 1""")
def e05(spark, sf):
    """E5: mean use and temperature by month number, years pooled."""
    return resample.monthly_mean(fx.covariates(spark, sf), ["use_kw", "temperature"])


_DEV_HOURLY = gapfilled_sql(METER_LONG, ["device"], "date_trunc('hour', ts)", "hour", "sum(kw) / 60.0", H_STEP)


@query("e06_kpi_total_peak_mean", f"""with h as ({_DEV_HOURLY}),
k as (select device, sum(kwh) as total, max(kwh) as peak, avg(kwh) as mean, count(*) as n_buckets from h group by 1)
select k.device, total, peak, (select min(hour) from h where h.device = k.device and h.kwh = k.peak) as peak_at,
  mean, n_buckets from k""")
def e06(spark, sf):
    """Per device hourly total, peak, first peak hour, mean, hour count."""
    h = resample.hourly_energy(fx.meter_long(spark, sf), "kw", keys=["device"], out_names=["kwh"])
    return kpi.kpi_total_peak_mean(h, "kwh", "hour", keys=["device"])


@query("e07_peak_and_min_points", f"""with d as ({_D25_DAILY}),
k as (select device, max(kwh) as peak, min(kwh) as min from d group by 1)
select k.device, peak, min,
  (select min(day) from d where d.device = k.device and d.kwh = k.peak) as peak_at,
  (select min(day) from d where d.device = k.device and d.kwh = k.min) as min_at from k""")
def e07(spark, sf):
    """Per device the first daily maximum and first daily minimum."""
    d = resample.daily_energy(fx.devices25(spark, sf), "kw", keys=["device"], out_names=["kwh"])
    return kpi.peak_and_min_points(d, "kwh", "day", keys=["device"])


@query("e08_site_summary", f"""select coalesce(sum(use_kw), 0) as total_use, coalesce(sum(gen_kw), 0) as total_gen,
  coalesce(sum(coalesce(use_kw, 0) - coalesce(gen_kw, 0)), 0) as total_net,
  case when coalesce(sum(use_kw), 0) > 0 then coalesce(sum(gen_kw), 0) / sum(use_kw) * 100 else 0 end as self_sufficiency_pct
from ({METER_WIDE})""")
def e08(spark, sf):
    """Site totals of use, generation, net and self-sufficiency %."""
    return kpi.site_summary(fx.meter_wide(spark, sf))


_TOTALS = f"select device, coalesce(sum(kw), 0) as total, coalesce(sum(kw), 0) / 60 as kwh from ({DEVICES25}) group by 1"


@query("e09_device_totals", _TOTALS)
def e09(spark, sf):
    """Total per device (raw sum and kWh)."""
    return kpi.device_totals(fx.devices25(spark, sf))


_SHARES = f"""with t as ({_TOTALS})
select device, total, kwh, round_even(total / (select sum(total) from t) * 100, 1) as share_pct from t"""


@query("e10_share_of_total", _SHARES)
def e10(spark, sf):
    """Share of each device in the total, 1 dp half-even."""
    return kpi.share_of_total(kpi.device_totals(fx.devices25(spark, sf)))


@query("e11_weather_summary", f"""with c as ({COVARIATES})
select 'temperature' as metric, 0 as ord, avg(temperature) as mean, min(temperature) as min, max(temperature) as max from c
union all select 'humidity', 1, avg(humidity), min(humidity), max(humidity) from c
union all select 'windSpeed', 2, avg(windSpeed), min(windSpeed), max(windSpeed) from c""")
def e11(spark, sf):
    """Mean / min / max of the weather metrics the table has."""
    return stats.weather_summary(fx.covariates(spark, sf))


@query("e12_high_usage_threshold", f"select avg(use_kw) + stddev_samp(use_kw) as threshold from ({COVARIATES})")
def e12(spark, sf):
    """High-usage threshold = mean + sample std of use."""
    return stats.high_usage_threshold(fx.covariates(spark, sf))


@query("e13_high_usage_probability", f"""with c as ({COVARIATES}),
t as (select avg(use_kw) + stddev_samp(use_kw) as thr from c),
p as (select {WEATHER_GROUP_SQL} as weather_group, avg(case when use_kw > (select thr from t) then 1.0 else 0.0 end) * 100 as high_usage_pct
      from c group by 1)
select g.weather_group, g.ord as weather_ord, p.high_usage_pct from {WEATHER_GROUPS_VALUES} left join p using (weather_group)""")
def e13(spark, sf):
    """% of rows above the threshold per weather group, all 11 groups."""
    return stats.high_usage_probability(fx.covariates(spark, sf))


@query("f03_ordered_groups", f"""with c as ({COVARIATES}),
m as (select {WEATHER_GROUP_SQL} as weather_group, avg(use_kw) as mean_use from c group by 1)
select g.weather_group, g.ord as weather_ord, m.mean_use from {WEATHER_GROUPS_VALUES} left join m using (weather_group)
order by g.ord""")
def f03(spark, sf):
    """mean use per weather group, sorted by the categorical order."""
    c = fx.covariates(spark, sf)
    m = c.groupBy(weather_group("summary").alias("weather_group")).agg(F.avg("use_kw").alias("mean_use"))
    return kpi.ordered_groups(F.broadcast(stats._groups_dim(spark)).join(m, "weather_group", "left"), "weather_ord")


_SITE_DAILY = gapfilled_sql(DEVICES25, [], "cast(ts as date)", "day", "sum(kw) / 60.0", D_STEP, btype="date")


def _site_daily(spark, sf):
    return resample.daily_energy(fx.devices25(spark, sf), "kw", out_names=["kwh"])


@query("e14_week_weekday_pivot", f"""with d as ({_SITE_DAILY}),
y as (select distinct year(day) as year from d),
g as (select year, unnest(generate_series(0, 6)) as weekday from y),
gw as (select year, weekday, unnest(generate_series(1, 53)) as week from g),
c as (select year(day) as year, isodow(day) - 1 as weekday, weekofyear(day) as week, avg(kwh) as mean_kwh from d group by all)
select gw.year, gw.weekday, gw.week, c.mean_kwh from gw left join c using (year, weekday, week)""")
def e14(spark, sf):
    """Mean daily kWh by weekday x ISO week for every year (7 x 53 cells)."""
    return calendar_grid.week_weekday_grid(_site_daily(spark, sf))


_WEEK_LABELS = f"""with d as ({_SITE_DAILY}),
y as (select distinct year(day) as year from d),
gw as (select year, unnest(generate_series(1, 53)) as week from y),
lab as (select year(day) as year, weekofyear(day) as week,
  strftime(make_date(year(day), 1, 1) + cast((8 - isodow(make_date(year(day), 1, 1))) % 7 + (weekofyear(day) - 1) * 7 + 3 as integer), '%B') as month_label
  from d),
f as (select year, week, min(month_label) as month_label from lab group by all),
l as (select gw.year, gw.week, coalesce(f.month_label, 'Unknown') as month_label from gw left join f using (year, week)),
p as (select *, last_value(case when month_label <> 'Unknown' then month_label end ignore nulls)
        over (partition by year order by week rows between unbounded preceding and 1 preceding) as prev from l)"""


@query("e17_first_label_per_week", _WEEK_LABELS + " select year, week, month_label from l")
def e17(spark, sf):
    """Month label of each week 1..53 (first day with data), else Unknown."""
    return calendar_grid.week_labels(_site_daily(spark, sf)).select("year", "week", "month_label")


@query("b16_label_on_change", _WEEK_LABELS + """ select year, week,
  case when month_label <> 'Unknown' and (prev is null or prev <> month_label) then month_label else '' end as display_label from p""")
def b16(spark, sf):
    """Week label shown only where it changes from the last shown one."""
    return calendar_grid.week_labels(_site_daily(spark, sf)).select("year", "week", "display_label")


@query("e15_box_stats", f"""with c as ({COVARIATES}),
g as (select {WEATHER_GROUP_SQL} as weather_group, use_kw from c where use_kw is not null),
q as (select weather_group, count(*) as n, quantile_cont(use_kw, 0.25) as q1, quantile_cont(use_kw, 0.5) as median,
      quantile_cont(use_kw, 0.75) as q3 from g group by 1),
f as (select *, q3 - q1 as iqr, q1 - 1.5 * (q3 - q1) as lower_fence, q3 + 1.5 * (q3 - q1) as upper_fence from q)
select f.weather_group, n, q1, median, q3, iqr, lower_fence, upper_fence,
  min(case when use_kw between lower_fence and upper_fence then use_kw end) as whisker_low,
  max(case when use_kw between lower_fence and upper_fence then use_kw end) as whisker_high,
  count(*) filter (where not (use_kw between lower_fence and upper_fence)) as n_outliers
from f join g using (weather_group) group by all""")
def e15(spark, sf):
    """Exact quartiles, fences, whiskers and outliers of use per group."""
    c = fx.covariates(spark, sf).withColumn("weather_group", weather_group("summary"))
    return stats.box_stats(c, "use_kw", "weather_group")


@query("e16_binned_mean", f"""with c as ({COVARIATES}),
m as (select min(temperature) as lo, max(temperature) as hi from c),
b as (select case when hi = lo then 0 else least(greatest(cast(ceil((temperature - lo) / ((hi - lo) / 10.0)) as bigint) - 1, 0), 9) end as bin,
      use_kw from c, m),
a as (select bin, avg(use_kw) as mean from b group by 1),
bins as (select cast(unnest(generate_series(0, 9)) as integer) as bin)
select bins.bin, printf('%.1f°C to %.1f°C', case when bins.bin = 0 then lo - (hi - lo) * 0.001 else lo + bins.bin * ((hi - lo) / 10.0) end,
       lo + (bins.bin + 1) * ((hi - lo) / 10.0)) as bin_label, a.mean
from bins cross join m left join a using (bin)""")
def e16(spark, sf):
    """Mean use per temperature bin (10 equal-width bins, all returned)."""
    return stats.binned_mean(fx.covariates(spark, sf), "temperature", "use_kw", 10)


_D25_RANGE = f"""with d as ({_D25_DAILY})
select device, coalesce(min(kwh), 0) as min_value, coalesce(max(kwh), 1) as max_value from d group by 1"""


@query("e19_value_range", _D25_RANGE)
def e19(spark, sf):
    """Min / max daily kWh per device (0 / 1 when empty)."""
    d = resample.daily_energy(fx.devices25(spark, sf), "kw", keys=["device"], out_names=["kwh"])
    return kpi.value_range(d, "kwh", keys=["device"])


@query("f01_top_k_devices", f"select device, total, kwh from ({_TOTALS}) order by total desc, device limit 5")
def f01(spark, sf):
    """the 5 devices with the largest totals."""
    return kpi.top_k(kpi.device_totals(fx.devices25(spark, sf)), 5)


@query("f02_top_k_plus_other", f"""with s as ({_SHARES}),
r as (select *, row_number() over (order by total desc, device) as rn from s)
select case when rn <= 5 then device else 'Other' end as device, sum(share_pct) as share_pct, min(rn) as rank
from r group by 1""")
def f02(spark, sf):
    """top 5 shares plus one Other row (sum of the remaining rounded shares)."""
    return kpi.top_k_plus_other(kpi.share_of_total(kpi.device_totals(fx.devices25(spark, sf))), 5)


@query("f05_sort_series", f"select day, kwh from ({_SITE_DAILY}) order by day")
def f05(spark, sf):
    """the site daily series, ascending by date."""
    return kpi.sort_series(_site_daily(spark, sf), "day")


def _dev_corr_sql(upper: str) -> str:
    return f"""with d as ({_D25_DAILY}),
m as (select x.device as a, y.device as b,
   case when x.device = y.device then (case when stddev_pop(x.kwh) > 0 then 1.0 end)
        else round_even(corr(x.kwh, y.kwh), 2) end as r
   from d x join d y on x.day = y.day group by x.device, y.device){upper}"""


@query("h01_corr_matrix_daily", _dev_corr_sql(" select a, b, r from m"))
def h01(spark, sf):
    """H1: Pearson matrix of the 25 device daily kWh series, 2 dp half-even."""
    return stats.corr_matrix_long(_d25_daily(spark, sf), "device", "day", "kwh")


def _d25_daily(spark, sf):
    return resample.daily_energy(fx.devices25(spark, sf), "kw", keys=["device"], out_names=["kwh"])


@query("f04_strongest_pairs", _dev_corr_sql(""",
u as (select * from m where a < b and r is not null and not isnan(r))
(select 'max' as kind, a, b, r from u order by r desc, a, b limit 1)
union all (select 'min' as kind, a, b, r from u order by r asc, a, b limit 1)"""))
def f04(spark, sf):
    """strongest positive and negative device pair (upper triangle)."""
    return stats.strongest_pairs(stats.corr_matrix_long(_d25_daily(spark, sf), "device", "day", "kwh"))


_WX = ["use_kw", "temperature", "humidity", "windSpeed"]


def _wx_corr_sql() -> str:
    parts = []
    for a in _WX:
        for b in _WX:
            r = (f"case when stddev_pop({a}) > 0 then 1.0 end" if a == b else f"round_even(corr({a}, {b}), 2)")
            parts.append(f"select '{a}' as a, '{b}' as b, {r} as r from c")
    return f"with c as ({COVARIATES}) " + " union all ".join(parts)


@query("h02_corr_matrix_weather", _wx_corr_sql())
def h02(spark, sf):
    """H2: Pearson matrix of use and the weather columns on all rows."""
    return stats.corr_matrix(fx.covariates(spark, sf), _WX).select("a", "b", "r")


@query("h03_ols", f"""select regr_slope(use_kw, temperature) as slope, regr_intercept(use_kw, temperature) as intercept,
  regr_r2(use_kw, temperature) as r2, regr_count(use_kw, temperature) as n from ({COVARIATES})""")
def h03(spark, sf):
    """H3: OLS of use on temperature over all complete rows."""
    return stats.ols(fx.covariates(spark, sf), "use_kw", "temperature")


@query("h04_ols_trend_points", f"""with c as ({COVARIATES}),
s as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, temperature, use_kw, hour(ts) as hour from c
      where temperature is not null and use_kw is not null),
f as (select regr_slope(use_kw, temperature) as slope, regr_intercept(use_kw, temperature) as intercept from s)
select s.*, intercept + slope * temperature as yhat from s, f""")
def h04(spark, sf):
    """H4: OLS trend line of use on temperature, fitted on and given for all complete rows."""
    c = fx.covariates(spark, sf).withColumn("hour", F.hour("ts"))
    return stats.ols_trend_points(c, "use_kw", "temperature", ROW_KEY, extra=["hour"])


@query("h08_standard_scale", f"""with c as ({COVARIATES}),
m as (select strftime(ts, '%Y-%m') as year_month, l_orderkey, l_linenumber, use_kw, temperature, humidity from c
      where use_kw is not null and temperature is not null and humidity is not null)
select year_month, l_orderkey, l_linenumber,
  (use_kw - avg(use_kw) over w) / coalesce(nullif(stddev_pop(use_kw) over w, 0), 1) as use_kw,
  (temperature - avg(temperature) over w) / coalesce(nullif(stddev_pop(temperature) over w, 0), 1) as temperature,
  (humidity - avg(humidity) over w) / coalesce(nullif(stddev_pop(humidity) over w, 0), 1) as humidity
from m window w as (partition by year_month)""")
def h08(spark, sf):
    """H8: per-month z-scores of use, temperature and humidity."""
    c = filters.drop_incomplete(fx.covariates(spark, sf), ["use_kw", "temperature", "humidity"])
    c = c.select(F.date_format("ts", "yyyy-MM").alias("year_month"), "l_orderkey", "l_linenumber",
                 "use_kw", "temperature", "humidity")
    return stats.standard_scale(c, ["use_kw", "temperature", "humidity"], keys=["year_month"])


@query("i01_sample_n", f"""select l_orderkey, l_linenumber, l_partkey, l_suppkey, use_kw, temperature from ({COVARIATES})
order by md5('42:' || cast(l_orderkey as varchar) || ':' || cast(l_linenumber as varchar) || ':' ||
             cast(l_partkey as varchar) || ':' || cast(l_suppkey as varchar)),
         l_orderkey, l_linenumber, l_partkey, l_suppkey limit 1000""", copied=("use_kw",))
def i01(spark, sf):
    """Exactly 1000 rows, repeatable under any partitioning (seed 42)."""
    c = fx.covariates(spark, sf).select(*ROW_KEY, "use_kw", "temperature")
    return sample_n(c, 1000, ROW_KEY, 42)
