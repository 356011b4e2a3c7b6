"""Query registry and the DuckDB text of the fixture roles.

Every registered query takes ``(spark, sf_dir)`` and returns a DataFrame over
the whole driver tables. The SQL twin (when one exists) is what an
independent engine computes for the same question; names of computed columns
match on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[QueryFn, str | None]] = {}
#: Float columns of a query that are copied from the tables, so both engines have the same bits.
COPIED: dict[str, frozenset[str]] = {}


def query(name: str, sql: str | None = None, copied: tuple[str, ...] = ()):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = (fn, sql)
        COPIED[name] = frozenset(copied)
        return fn
    return deco


# DuckDB text of the fixture roles (same projections as sources/fixtures.py).
METER_LONG = ("select user_id as meter_id, event_id, ts, event_type as device, value as kw "
              "from events")
METER_WIDE = """select event_id, ts,
  case when event_type <> 'signup' then value end as use_kw,
  case when event_type = 'signup' then value end as gen_kw,
  case when event_type = 'click' then value end as click,
  case when event_type = 'error' then value end as error,
  case when event_type = 'purchase' then value end as purchase,
  case when event_type = 'signup' then value end as signup,
  case when event_type = 'view' then value end as "view"
from events"""
JUNK_TEXT = ("select event_id, ts, case when event_id % 7 = 0 then 'cloudCover' "
             "else cast(value as varchar) end as cloudCover from events")
DEVICES25 = ("select l_orderkey, l_linenumber, l_shipdate as ts, p_brand as device, l_quantity as kw "
             "from lineitem join part on l_partkey = p_partkey")
SERIES6 = ("select p_type as series, l_shipdate as ts, l_quantity as kw "
           "from lineitem join part on l_partkey = p_partkey")
COVARIATES = """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate as ts, l_extendedprice as use_kw,
  l_quantity * 2 as temperature, l_discount as humidity, l_tax as windSpeed,
  case o_orderpriority when '1-URGENT' then 'Clear' when '2-HIGH' then 'Partly Cloudy'
    when '3-MEDIUM' then 'Overcast' when '4-NOT SPECIFIED' then 'Light Rain'
    when '5-LOW' then 'Fog' end as summary
from lineitem join orders on l_orderkey = o_orderkey"""
WEATHER_GROUP_SQL = """case summary when 'Clear' then 'Clear' when 'Partly Cloudy' then 'Partly Cloudy'
    when 'Mostly Cloudy' then 'Mostly Cloudy' when 'Overcast' then 'Overcast'
    when 'Drizzle' then 'Drizzle' when 'Light Rain' then 'Light Rain' when 'Rain' then 'Rain'
    when 'Light Snow' then 'Light Snow' when 'Flurries' then 'Flurries' when 'Breezy' then 'Breezy'
    else 'Other' end"""
WEATHER_GROUPS_VALUES = ("(values ('Clear',0),('Partly Cloudy',1),('Mostly Cloudy',2),('Overcast',3),"
                         "('Drizzle',4),('Light Rain',5),('Rain',6),('Light Snow',7),('Flurries',8),"
                         "('Breezy',9),('Other',10)) g(weather_group, ord)")


def gapfilled_sql(src: str, keys: list[str], bucket_expr: str, bucket: str, value_expr: str,
                  step: str, out: str = "kwh", fill: str | None = "0", btype: str = "timestamp") -> str:
    """SQL twin of ``resample(..., gap_fill=...)``: aggregate, then every bucket
    of each key's span, left joined."""
    k = ", ".join(keys)
    kc = (k + ", ") if keys else ""
    using = ", ".join(keys + [bucket])
    fill_expr = f"coalesce(a.{out}, {fill})" if fill is not None else f"a.{out}"
    gb = "group by all"
    span_gb = f"group by {k}" if keys else ""
    return f"""with src as ({src}),
a as (select {kc}{bucket_expr} as {bucket}, {value_expr} as {out} from src {gb}),
span as (select {kc}min({bucket}) as lo, max({bucket}) as hi from a {span_gb}),
cal as (select {kc}cast(unnest(generate_series(lo, hi, {step})) as {btype}) as {bucket} from span)
select {", ".join(["cal." + x for x in keys] + ["cal." + bucket])}, {fill_expr} as {out}
from cal left join a using ({using})"""
