"""Registered queries for scans, sinks, projections and filters (A, B, C)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.functions import calendar as cal
from meterlake.functions import energy as en
from meterlake.functions import weather as wx
from meterlake.functions.binning import bin_edges, bin_label, equal_width_bin
from meterlake.operators import clean, filters, ingest, resample, rollup
from meterlake.operators.sampling import sample_n
from meterlake.plans.catalog import (COVARIATES, JUNK_TEXT, METER_LONG, METER_WIDE, query)
from meterlake.session import shared_dir
from meterlake.sources import fixtures as fx
from meterlake.sources.tables import read_csv_back, read_silver, read_table, scan_meter_csv, write_csv, write_silver

# ---------------------------------------------------------------- A: scans


@query("a01_scan_meter", f"select meter_id, event_id, ts, device, kw from ({METER_LONG})")
def a01(spark, sf):
    """A1: the meter table as read (NaN -> NULL), long layout."""
    return fx.meter_long(spark, sf)


@query("a02_drop_last_row", """select event_id, ts, event_type as device, value as kw from events
where event_id < (select max(event_id) from events)""")
def a02(spark, sf):
    """A2: drop the final row in order-key order."""
    return ingest.drop_last_row(fx.indexed(spark, sf), "event_id")


@query("a03_assign_regular_time", """select event_id, event_type as device, value as kw,
  timestamp '2016-01-01 05:00:00' + to_minutes(cast(row_number() over (order by event_id) - 1 as bigint)) as ts
from events""")
def a03(spark, sf):
    """A3: replace the time by start + position minutes, position in event_id order."""
    return ingest.assign_regular_time(fx.indexed(spark, sf).drop("ts"), "event_id")


@query("a04_select_numeric", "select event_id, user_id, value from events")
def a04(spark, sf):
    """A4: numeric columns only."""
    return ingest.select_numeric(read_table(spark, sf, "events"))


@query("a05_guarded_project", "select cast(null as date) as day, cast(null as double) as kwh where false")
def a05(spark, sf):
    """A5: daily energy of a column the table does not have -> empty, no error."""
    return resample.daily_energy(fx.meter_wide(spark, sf), "Solar [kW]", out_names=["kwh"])


SAMPLE_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("use_kw", T.DoubleType()), T.StructField("gen_kw", T.DoubleType())])


@query("a06_export_sample_csv", """select event_id, ts, use_kw, gen_kw from (
  select event_id, ts, use_kw, gen_kw, md5('42:' || cast(event_id as varchar)) as h from (""" + METER_WIDE + """))
order by h, event_id limit 1000""")
def a06(spark, sf):
    """1000-row repeatable sample written as header CSV (shared folder),
    read back."""
    s = sample_n(fx.meter_wide(spark, sf).select("event_id", "ts", "use_kw", "gen_kw"), 1000, ["event_id"])
    path = write_csv(s, shared_dir(spark, f"exports/sample-{uuid.uuid4().hex}"))
    return read_csv_back(spark, path, SAMPLE_SCHEMA)


MISSING_START, MISSING_END = "2023-12-25", "2024-02-05"


@query("a07_export_missing_dates", f"""with d as ({METER_LONG}),
span as (select device, min(cast(ts as date)) as lo, max(cast(ts as date)) as hi from d group by device),
cal as (select device, lo, hi, cast(unnest(generate_series(date '{MISSING_START}', date '{MISSING_END}', interval 1 day)) as date) as day from span)
select device, strftime(day, '%d/%m/%Y') as missing_date from cal where day < lo or day > hi""")
def a07(spark, sf):
    """Days of the requested range with no daily value, ``dd/MM/yyyy``,
    written as CSV and read back."""
    daily = resample.daily_energy(fx.meter_long(spark, sf), "kw", keys=["device"], out_names=["y"])
    done = resample.complete_calendar(daily.withColumnRenamed("day", "ds"), MISSING_START, MISSING_END,
                                      keys=["device"])
    miss = done.where(F.col("y").isNull()).select(
        "device", cal.date_label("ds").alias("missing_date"))
    path = write_csv(miss, shared_dir(spark, f"exports/missing-{uuid.uuid4().hex}"))
    return read_csv_back(spark, path, T.StructType([
        T.StructField("device", T.StringType()), T.StructField("missing_date", T.StringType())]))


@query("a08_date_bounds", f"""select device, min(cast(ts as date)) as min_date, max(cast(ts as date)) as max_date
from ({METER_LONG}) group by device""")
def a08(spark, sf):
    """First and last date per device."""
    return ingest.date_bounds(fx.meter_long(spark, sf), keys=["device"])


@query("a09_distinct_periods", "select distinct cast(ts as date) as period from events")
def a09(spark, sf):
    """Distinct dates (newest first)."""
    return ingest.distinct_periods(read_table(spark, sf, "events"), period="date")


@query("a09y_distinct_years", "select distinct year(ts) as period from events")
def a09y(spark, sf):
    """Distinct years (newest first)."""
    return ingest.distinct_periods(read_table(spark, sf, "events"), period="year")


@query("a09m_distinct_months", "select distinct strftime(l_shipdate, '%Y-%m') as period from lineitem")
def a09m(spark, sf):
    """Distinct months (oldest first)."""
    return ingest.distinct_periods(read_table(spark, sf, "lineitem"), "l_shipdate", "month")


# --------------------------------------------------------- load pipeline

LOAD_SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("use_kw", T.DoubleType()),
                            T.StructField("gen_kw", T.DoubleType()), T.StructField("cloudCover", T.StringType())])


def _load_input(spark, sf):
    """The events as meter CSV files in ``event_id`` order: only rows in the schema that the scan expects."""
    ev = read_table(spark, sf, "events")
    junk = F.when(F.col("event_id") % 7 == 0, F.lit("cloudCover")).otherwise(F.col("value").cast("string"))
    rows = ev.select("event_id", F.col("value").alias("use_kw"),
                     F.when(F.col("event_type") == "signup", F.col("value")).alias("gen_kw"), junk.alias("cloudCover"))
    return write_csv(rows.orderBy("event_id"), shared_dir(spark, f"exports/meter-{uuid.uuid4().hex}"))


_LOAD_SQL = """e as (select event_id, value as use_kw, case when event_type = 'signup' then value end as gen_kw,
  case when event_id % 7 <> 0 then value end as c, row_number() over (order by event_id) - 1 as p from events),
f as (select *, timestamp '2016-01-01 05:00:00' + to_minutes(cast(p as bigint)) as ts,
  first_value(c ignore nulls) over (order by event_id rows between current row and unbounded following) as cloud
  from e where event_id < (select max(event_id) from events)),
g as (select event_id, ts, use_kw, gen_kw, cloud as cloudCover, use_kw - gen_kw as net_kw,
  case when use_kw > 0 then gen_kw / use_kw else 0 end as ratio, year(ts) as year, month(ts) as month, day(ts) as day,
  dayname(ts) as day_name, weekofyear(ts) as weekofyear, hour(ts) as hour, minute(ts) as minute, cast(ts as date) as date,
  isodow(ts) - 1 as day_of_week, strftime(ts, '%Y-%m') as year_month from f)"""


def _silver(spark, sf):
    raw = scan_meter_csv(spark, _load_input(spark, sf), LOAD_SCHEMA)
    loaded = ingest.load_pipeline(raw).drop("row_order")
    return write_silver(loaded, shared_dir(spark, f"silver/meter-{uuid.uuid4().hex}"))


@query("m2_load_pipeline", f"with {_LOAD_SQL} select * from g")
def m2(spark, sf):
    """A1, A2, A3, B1, B5, B3 and B4 in a row: CSV scan, last row dropped, regular time axis, calendar, cleaning, net and
    ratio of every row, written as Parquet by month and read back."""
    return read_silver(spark, _silver(spark, sf)).withColumn("year_month", F.col("year_month").cast("string"))


@query("m3_silver_month_energy", f"""with {_LOAD_SQL} select year_month, cast(ts as date) as day, sum(use_kw) / 60.0 as use_kwh
from g group by all""")
def m3(spark, sf):
    """Daily use of every month from the monthly table's hourly roll-up; the hours of a month are filled within the month."""
    silver = read_silver(spark, _silver(spark, sf)).withColumn("year_month", F.col("year_month").cast("string"))
    hourly = resample.hourly_energy(silver, "use_kw", keys=["year_month"], out_names=["use_kwh"])
    return hourly.groupBy("year_month", F.to_date("hour").alias("day")).agg(F.sum("use_kwh").alias("use_kwh"))


@query("m4_rollup_day_kpis", f"""with {_LOAD_SQL},
h as (select date_trunc('hour', ts) as hour, sum(use_kw) / 60.0 as kwh from g group by 1),
span as (select min(hour) as lo, max(hour) as hi from h),
every as (select unnest(generate_series(lo, hi, interval 1 hour)) as hour from span),
filled as (select every.hour, coalesce(kwh, 0) as kwh from every left join h using (hour))
select cast(hour as date) as day, sum(kwh) as total_kwh, max(kwh) as peak_kwh, avg(kwh) as mean_kwh from filled group by 1""")
def m4(spark, sf):
    """E1 and E6 per day from the hourly roll-up that is kept by month: built, refreshed once more (no month is read again), and read."""
    silver, path = _silver(spark, sf), shared_dir(spark, f"rollup/meter-{uuid.uuid4().hex}")
    rollup.refresh_hourly(spark, silver, path, ["use_kw"], out_names=["kwh"])
    if rollup.refresh_hourly(spark, silver, path, ["use_kw"], out_names=["kwh"]):
        raise RuntimeError("unchanged months were rolled up again")
    hours = rollup.read_hourly(spark, path, ["kwh"])
    return hours.groupBy(F.to_date("hour").alias("day")).agg(F.sum("kwh").alias("total_kwh"), F.max("kwh").alias("peak_kwh"), F.avg("kwh").alias("mean_kwh"))


# --------------------------------------------------------- B: projections


@query("b01_calendar_features", """select event_id, year(ts) as year, month(ts) as month, day(ts) as day,
  dayname(ts) as day_name, weekofyear(ts) as weekofyear, hour(ts) as hour, minute(ts) as minute,
  cast(ts as date) as date, isodow(ts) - 1 as day_of_week from events""")
def b01(spark, sf):
    """B1: calendar features of every reading."""
    ev = read_table(spark, sf, "events").select("event_id", "ts")
    return cal.calendar_features(ev).drop("ts")


@query("b02_weekend", "select event_id, isodow(ts) in (6, 7) as weekend from events")
def b02(spark, sf):
    """B2: weekend flag."""
    return read_table(spark, sf, "events").select("event_id", cal.weekend("ts").alias("weekend"))


def _hourly_site_sql(extra: str) -> str:
    return f"""with w as ({METER_WIDE}),
a as (select date_trunc('hour', ts) as hour, sum(use_kw) / 60.0 as u, sum(gen_kw) / 60.0 as g from w group by all),
cal as (select unnest(generate_series(min(hour), max(hour), interval 1 hour)) as hour from a),
h as (select cal.hour, coalesce(a.u, 0) as use_kwh, coalesce(a.g, 0) as gen_kwh from cal left join a using (hour))
{extra}"""


@query("b03_net_energy", _hourly_site_sql("select hour, use_kwh - gen_kwh as net_kwh from h"))
def b03(spark, sf):
    """Hourly net energy = use - generation (both gap-filled)."""
    return resample.align_use_gen(fx.meter_wide(spark, sf)).select("hour", "net_kwh")


@query("b03d_net_energy_daily", f"""with w as ({METER_WIDE}),
a as (select cast(ts as date) as day, sum(use_kw) / 60.0 as u, sum(gen_kw) / 60.0 as g from w group by all),
cal as (select cast(unnest(generate_series(min(day), max(day), interval 1 day)) as date) as day from a)
select day, coalesce(u, 0) - coalesce(g, 0) as net_kwh from cal left join a using (day)""")
def b03d(spark, sf):
    """Daily net energy."""
    return resample.align_use_gen(fx.meter_wide(spark, sf), freq="day").select("day", "net_kwh")


@query("b03r_net_and_ratio_rows", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity - l_tax as net,
  case when l_quantity > 0 then l_tax / l_quantity else 0 end as ratio from lineitem""")
def b03r(spark, sf):
    """B3 and B4 for every row."""
    li = read_table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", en.net_energy("l_quantity", "l_tax").alias("net"),
                     en.energy_ratio("l_quantity", "l_tax").alias("ratio"))


@query("d01o_align_two_tables", """with u as (select date_trunc('hour', ts) as hour, sum(value) / 60.0 as use_kwh from events where event_type = 'view' group by 1),
g as (select date_trunc('hour', ts) as hour, sum(value) / 60.0 as gen_kwh from events where event_type = 'signup' group by 1)
select hour, coalesce(use_kwh, 0) as use_kwh, coalesce(gen_kwh, 0) as gen_kwh from u full join g using (hour)""")
def d01o(spark, sf):
    """D1 for two tables: hours of either side, missing = 0."""
    ev = fx.meter_long(spark, sf)

    def hours(device: str, name: str):
        return resample.hourly_energy(ev.where(F.col("device") == device), "kw", gap_fill=None, out_names=[name])

    return resample.align_two(hours("view", "use_kwh"), hours("signup", "gen_kwh"), ["hour"], "use_kwh", "gen_kwh")


@query("b04_energy_ratio", _hourly_site_sql(
    "select hour, case when use_kwh > 0 then gen_kwh / use_kwh else 0 end as energy_ratio from h"))
def b04(spark, sf):
    """Hourly generation / use, 0 when use is not positive."""
    h = resample.align_use_gen(fx.meter_wide(spark, sf))
    return h.select("hour", en.energy_ratio("use_kwh", "gen_kwh").alias("energy_ratio"))


@query("b05_clean_backfill", f"""select event_id, cast(first_value(case when cloudCover <> 'cloudCover' then cloudCover end ignore nulls)
  over (order by ts, event_id rows between current row and unbounded following) as double) as cloudCover
from ({JUNK_TEXT})""")
def b05(spark, sf):
    """Junk literal replaced by the next valid value (time order), as double."""
    j = fx.junk_text(spark, sf)
    return clean.clean_backfill(j, "cloudCover", ["ts", "event_id"]).select("event_id", "cloudCover")


@query("b06_fahrenheit_to_celsius", f"""with c as ({COVARIATES})
select l_orderkey, l_linenumber, case when (select max(temperature) from c) > 80
  then (temperature - 32) * 5.0 / 9.0 else temperature end as temperature from c""")
def b06(spark, sf):
    """Convert temperature to Celsius when its max is above 80."""
    c = fx.covariates(spark, sf).select("l_orderkey", "l_linenumber", "temperature")
    return clean.fahrenheit_to_celsius(c)


@query("b07_to_numeric_coerce", f"select event_id, try_cast(cloudCover as double) as cloudCover from ({JUNK_TEXT})")
def b07(spark, sf):
    """Unparsable text -> NULL."""
    return clean.to_numeric_columns(fx.junk_text(spark, sf), ["cloudCover"]).select("event_id", "cloudCover")


@query("b08_season", f"""select l_orderkey, l_linenumber, month(ts) as month,
  case when month(ts) in (12, 1, 2) then 'Winter' when month(ts) in (3, 4, 5) then 'Spring'
       when month(ts) in (6, 7, 8) then 'Summer' else 'Autumn' end as season from ({COVARIATES})""")
def b08(spark, sf):
    """Season of the month."""
    c = fx.covariates(spark, sf)
    return c.select("l_orderkey", "l_linenumber", F.month("ts").alias("month"),
                    wx.season(F.month("ts")).alias("season"))


@query("b09_weather_group", f"""with c as ({COVARIATES}),
g as (select l_orderkey, l_linenumber, case summary when 'Clear' then 'Clear' when 'Partly Cloudy' then 'Partly Cloudy'
    when 'Mostly Cloudy' then 'Mostly Cloudy' when 'Overcast' then 'Overcast' when 'Drizzle' then 'Drizzle'
    when 'Light Rain' then 'Light Rain' when 'Rain' then 'Rain' when 'Light Snow' then 'Light Snow'
    when 'Flurries' then 'Flurries' when 'Breezy' then 'Breezy' else 'Other' end as weather_group from c)
select l_orderkey, l_linenumber, weather_group,
  list_position(['Clear','Partly Cloudy','Mostly Cloudy','Overcast','Drizzle','Light Rain','Rain',
                 'Light Snow','Flurries','Breezy','Other'], weather_group) - 1 as weather_ord from g""")
def b09(spark, sf):
    """Weather text -> group (unmapped -> Other) and its display position."""
    c = fx.covariates(spark, sf)
    g = wx.weather_group("summary")
    return c.select("l_orderkey", "l_linenumber", g.alias("weather_group"),
                    wx.weather_group_ord(g).alias("weather_ord"))


@query("b10_year_month", f"select l_orderkey, l_linenumber, strftime(ts, '%Y-%m') as year_month from ({COVARIATES})")
def b10(spark, sf):
    """YYYY-MM period text."""
    return fx.covariates(spark, sf).select("l_orderkey", "l_linenumber", cal.year_month("ts").alias("year_month"))


@query("b11_kw_minutes_to_kwh", f"select device, sum(kw) / 60.0 as kwh from ({METER_LONG}) group by device")
def b11(spark, sf):
    """kW readings summed per device as kWh."""
    return (fx.meter_long(spark, sf).groupBy("device")
            .agg(en.kw_to_kwh(F.sum("kw")).alias("kwh")))


@query("b12_strip_unit", "select p_partkey, replace(p_brand || ' [kW]', ' [kW]', '') as device from part")
def b12(spark, sf):
    """Unit suffix removed from a device label."""
    p = read_table(spark, sf, "part")
    return p.select("p_partkey", en.strip_unit(F.concat("p_brand", F.lit(" [kW]"))).alias("device"))


@query("b13_date_labels", """select distinct cast(ts as date) as day, strftime(ts, '%d/%m/%Y') as date_label,
  strftime(ts, '%d/%m') as day_month, strftime(ts, '%B') as month_name from events""")
def b13(spark, sf):
    """Fixed date label formats of every day with readings."""
    d = read_table(spark, sf, "events").select(F.to_date("ts").alias("day")).distinct()
    return d.select("day", cal.date_label("day").alias("date_label"),
                    cal.date_label("day", cal.DAY_MONTH_LABEL).alias("day_month"),
                    cal.date_label("day", cal.MONTH_NAME).alias("month_name"))


def _years_weeks_sql(extra_cols: str, weekday: bool = False) -> str:
    wd = ", unnest(generate_series(0, 6)) as weekday" if weekday else ""
    return f"""with y as (select distinct year(l_shipdate) as year from lineitem),
yw as (select year, unnest(generate_series(1, 53)) as week from y),
b as (select year, week{wd},
  make_date(year, 1, 1) + cast((8 - isodow(make_date(year, 1, 1))) % 7 + (week - 1) * 7 as integer) as monday,
  make_date(year, 1, 4) - cast(isodow(make_date(year, 1, 4)) - 1 as integer) + cast((week - 1) * 7 as integer) as iso_monday
  from yw)
select {extra_cols} from b"""


def _years_weeks(spark, sf):
    years = read_table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("year")).distinct()
    return years.select("year", F.explode(F.sequence(F.lit(1), F.lit(53))).alias("week"))


@query("b14_week_dominant_month", _years_weeks_sql(
    "year, week, monday, strftime(monday + 3, '%B') as month_label, strftime(iso_monday + 3, '%B') as month_label_iso"))
def b14(spark, sf):
    """Monday and majority month of every (year, week 1..53) of the data's
    years, by the reference (%W) rule and by the ISO rule."""
    yw = _years_weeks(spark, sf)
    return yw.select("year", "week", cal.week_monday("year", "week").alias("monday"),
                     cal.week_dominant_month("year", "week").alias("month_label"),
                     cal.week_dominant_month("year", "week", rule="iso").alias("month_label_iso"))


@query("b15_week_weekday_to_date", _years_weeks_sql(
    "year, week, weekday, strftime(monday + cast(weekday as integer), '%d/%m/%Y') as date_label", weekday=True))
def b15(spark, sf):
    """The date of every (year, week, weekday) cell, dd/MM/yyyy."""
    yw = _years_weeks(spark, sf).select("year", "week", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("weekday"))
    return yw.select("year", "week", "weekday",
                     cal.week_weekday_date("year", "week", "weekday").alias("date_label"))


@query("b17_equal_width_bin", f"""with c as ({COVARIATES}),
m as (select min(temperature) as lo, max(temperature) as hi from c),
b as (select l_orderkey, l_linenumber,
  case when hi = lo then 0 else least(greatest(cast(ceil((temperature - lo) / ((hi - lo) / 10.0)) as bigint) - 1, 0), 9) end as bin,
  lo, hi from c, m)
select l_orderkey, l_linenumber, bin,
  printf('%.1f°C to %.1f°C', case when bin = 0 then lo - (hi - lo) * 0.001 else lo + bin * ((hi - lo) / 10.0) end,
         lo + (bin + 1) * ((hi - lo) / 10.0)) as bin_label from b""")
def b17(spark, sf):
    """10 equal-width right-closed temperature bins and their labels."""
    c = fx.covariates(spark, sf)
    lo = c.select(F.min("temperature")).scalar()
    hi = c.select(F.max("temperature")).scalar()
    b = equal_width_bin(F.col("temperature"), lo, hi, 10)
    d = c.select("l_orderkey", "l_linenumber", b.alias("bin"))
    left, right = bin_edges(F.col("bin"), lo, hi, 10)
    return d.select("l_orderkey", "l_linenumber", "bin", bin_label(left, right).alias("bin_label"))


# ------------------------------------------------------------ C: filters


@query("c01_between_dates",
       "select event_id, ts from events where cast(ts as date) between date '2024-01-05' and date '2024-01-12'")
def c01(spark, sf):
    """Dates 2024-01-05 .. 2024-01-12, both ends included."""
    return filters.between_dates(read_table(spark, sf, "events"), "2024-01-05", "2024-01-12").select("event_id", "ts")


@query("c02_on_date", "select event_id, ts from events where cast(ts as date) = date '2024-01-10'")
def c02(spark, sf):
    """One day."""
    return filters.on_date(read_table(spark, sf, "events"), "2024-01-10").select("event_id", "ts")


@query("c03_hour_between", _hourly_site_sql("select hour, use_kwh from h where hour(hour) between 8 and 18"))
def c03(spark, sf):
    """Hourly use between 08:00 and 18:00 inclusive."""
    h = resample.align_use_gen(fx.meter_wide(spark, sf))
    return filters.hour_between(h, 8, 18).select("hour", "use_kwh")


@query("c04_year_and_month_between", """select l_orderkey, l_linenumber, l_shipdate as ts from lineitem
where year(l_shipdate) = 1998 and month(l_shipdate) between 3 and 9""")
def c04(spark, sf):
    """C4: year 1998, months 3..9."""
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("ts"))
    return filters.year_and_month_between(li, 1998, 3, 9)


@query("c05_mask_outside", _hourly_site_sql(
    "select hour, case when use_kwh between 10 and 30 then use_kwh end as use_kwh from h"))
def c05(spark, sf):
    """Hourly use outside [10, 30] kWh becomes NULL, rows kept."""
    h = resample.align_use_gen(fx.meter_wide(spark, sf)).select("hour", "use_kwh")
    return filters.mask_outside(h, "use_kwh", 10, 30)


@query("c07_drop_incomplete", f"select event_id from ({METER_WIDE}) where use_kw is not null")
def c07(spark, sf):
    """Rows with a NULL use dropped."""
    return filters.drop_incomplete(fx.meter_wide(spark, sf), ["use_kw"]).select("event_id")


@query("c08_dedup_keep_last", f"""select device, day, event_id, kw from (
  select device, cast(ts as date) as day, event_id, kw,
    row_number() over (partition by device, cast(ts as date) order by ts desc, event_id desc) as rn
  from ({METER_LONG})) where rn = 1""")
def c08(spark, sf):
    """Per (device, day) the last reading wins."""
    m = fx.meter_long(spark, sf).withColumn("day", F.to_date("ts"))
    return filters.dedup_keep_last(m.select("device", "day", "ts", "event_id", "kw"), ["device", "day"],
                                   "ts", ["event_id"]).select("device", "day", "event_id", "kw")
