"""Registered queries with series keys: the same operators, one result per meter."""

from __future__ import annotations

from meterlake.operators import calendar_grid, resample, stats
from meterlake.plans.catalog import COVARIATES, DEVICES25, WEATHER_GROUP_SQL, WEATHER_GROUPS_VALUES, gapfilled_sql, query
from meterlake.plans.energy_kpi import D_STEP
from meterlake.sources import fixtures as fx

METER = ["l_linenumber"]  # seven meters


@query("e11k_weather_summary_by_meter", f"""with c as ({COVARIATES})
select l_linenumber, 'temperature' as metric, 0 as ord, avg(temperature) as mean, min(temperature) as min, max(temperature) as max from c group by 1
union all select l_linenumber, 'humidity', 1, avg(humidity), min(humidity), max(humidity) from c group by 1
union all select l_linenumber, 'windSpeed', 2, avg(windSpeed), min(windSpeed), max(windSpeed) from c group by 1""")
def e11k(spark, sf):
    """E11 per meter."""
    return stats.weather_summary(fx.covariates(spark, sf), keys=METER)


@query("e12k_high_usage_threshold_by_meter", f"select l_linenumber, avg(use_kw) + stddev_samp(use_kw) as threshold from ({COVARIATES}) group by 1")
def e12k(spark, sf):
    """E12 per meter."""
    return stats.high_usage_threshold(fx.covariates(spark, sf), keys=METER)


@query("e13k_high_usage_probability_by_meter", f"""with c as ({COVARIATES}),
t as (select l_linenumber, avg(use_kw) + stddev_samp(use_kw) as thr from c group by 1),
p as (select l_linenumber, {WEATHER_GROUP_SQL} as weather_group, avg(case when use_kw > thr then 1.0 else 0.0 end) * 100 as high_usage_pct
      from c join t using (l_linenumber) group by 1, 2)
select t.l_linenumber, g.weather_group, g.ord as weather_ord, p.high_usage_pct
from t cross join {WEATHER_GROUPS_VALUES} left join p on p.l_linenumber = t.l_linenumber and p.weather_group = g.weather_group""")
def e13k(spark, sf):
    """E13 per meter: thresholds and all 11 groups of each."""
    return stats.high_usage_probability(fx.covariates(spark, sf), keys=METER)


@query("e16k_binned_mean_by_meter", f"""with c as ({COVARIATES}),
m as (select l_linenumber, min(temperature) as lo, max(temperature) as hi from c group by 1),
b as (select l_linenumber, case when hi = lo then 0 else least(greatest(cast(ceil((temperature - lo) / ((hi - lo) / 10.0)) as bigint) - 1, 0), 9) end as bin,
      use_kw from c join m using (l_linenumber)),
a as (select l_linenumber, bin, avg(use_kw) as mean from b group by 1, 2),
bins as (select l_linenumber, lo, hi, cast(unnest(generate_series(0, 9)) as integer) as bin from m)
select l_linenumber, bins.bin, printf('%.1f°C to %.1f°C', case when bins.bin = 0 then lo - (hi - lo) * 0.001 else lo + bins.bin * ((hi - lo) / 10.0) end,
       lo + (bins.bin + 1) * ((hi - lo) / 10.0)) as bin_label, a.mean
from bins left join a using (l_linenumber, bin)""")
def e16k(spark, sf):
    """E16 per meter: ten bins over each meter's own range."""
    return stats.binned_mean(fx.covariates(spark, sf), "temperature", "use_kw", 10, keys=METER)


_DAILY = gapfilled_sql(DEVICES25, ["device"], "cast(ts as date)", "day", "sum(kw) / 60.0", D_STEP, btype="date")


def _daily(spark, sf):
    return resample.daily_energy(fx.devices25(spark, sf), "kw", keys=["device"], out_names=["kwh"])


@query("e14k_week_weekday_by_device", f"""with d as ({_DAILY}),
y as (select distinct device, year(day) as year from d),
g as (select device, year, unnest(generate_series(0, 6)) as weekday from y),
gw as (select device, year, weekday, unnest(generate_series(1, 53)) as week from g),
c as (select device, year(day) as year, isodow(day) - 1 as weekday, weekofyear(day) as week, avg(kwh) as mean_kwh from d group by all)
select gw.device, gw.year, gw.weekday, gw.week, c.mean_kwh from gw left join c using (device, year, weekday, week)""")
def e14k(spark, sf):
    """E14 per device."""
    return calendar_grid.week_weekday_grid(_daily(spark, sf), keys=["device"])


@query("e17k_week_labels_by_device", f"""with d as ({_DAILY}),
y as (select distinct device, year(day) as year from d),
gw as (select device, year, unnest(generate_series(1, 53)) as week from y),
lab as (select device, year(day) as year, weekofyear(day) as week,
  strftime(make_date(year(day), 1, 1) + cast((8 - isodow(make_date(year(day), 1, 1))) % 7 + (weekofyear(day) - 1) * 7 + 3 as integer), '%B') as month_label
  from d),
f as (select device, year, week, min(month_label) as month_label from lab group by all),
l as (select gw.device, gw.year, gw.week, coalesce(f.month_label, 'Unknown') as month_label from gw left join f using (device, year, week)),
p as (select *, last_value(case when month_label <> 'Unknown' then month_label end ignore nulls)
        over (partition by device, year order by week rows between unbounded preceding and 1 preceding) as prev from l)
select device, year, week, month_label, case when month_label <> 'Unknown' and (prev is null or prev <> month_label) then month_label else '' end as display_label from p""")
def e17k(spark, sf):
    """E17 and B16 per device: every week's month label, and where it is shown."""
    return calendar_grid.week_labels(_daily(spark, sf), keys=["device"])
