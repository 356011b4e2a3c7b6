"""Registered smoother and density queries (H5, H6, H7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlake.functions.weather import season
from meterlake.operators import density
from meterlake.plans.catalog import COVARIATES, query
from meterlake.sources import fixtures as fx

ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _cov(spark, sf):
    return fx.covariates(spark, sf).withColumn("season", season(F.month("ts")))


@query("h05_lowess")
def h05(spark, sf):
    """H5: LOWESS of use on temperature (frac 2/3, 3 robust passes) over all rows."""
    return density.lowess(_cov(spark, sf), "use_kw", "temperature", ROW_KEY)


@query("h06_kde2d")
def h06(spark, sf):
    """H6: 2-D density of (temperature, use) over all rows on a 200 x 200
    grid, with the 5 % mass contour level."""
    return density.kde2d(_cov(spark, sf), "temperature", "use_kw")


_SEASON_SQL = f"""with c as ({COVARIATES}),
s as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, temperature,
        case when month(ts) in (12, 1, 2) then 'Winter' when month(ts) in (3, 4, 5) then 'Spring'
             when month(ts) in (6, 7, 8) then 'Summer' else 'Autumn' end as season
      from c where temperature is not null),
q as (select season, count(*) as n, quantile_cont(temperature, 0.25) as q1, quantile_cont(temperature, 0.5) as median,
      quantile_cont(temperature, 0.75) as q3 from s group by 1),
f as (select *, q3 - q1 as iqr, q1 - 1.5 * (q3 - q1) as lower_fence, q3 + 1.5 * (q3 - q1) as upper_fence from q)
select f.season, n, q1, median, q3, iqr, lower_fence, upper_fence,
  min(case when temperature between lower_fence and upper_fence then temperature end) as whisker_low,
  max(case when temperature between lower_fence and upper_fence then temperature end) as whisker_high,
  count(*) filter (where not (temperature between lower_fence and upper_fence)) as n_outliers
from f join s using (season) group by all"""


@query("h07_season_distribution", _SEASON_SQL)
def h07(spark, sf):
    """H7: temperature distribution per season over all rows: exact
    quartiles, whiskers, outliers."""
    return density.season_box(_cov(spark, sf), "temperature")


@query("h07_season_density")
def h07d(spark, sf):
    """H7: per-season 1-D density of temperature over all rows."""
    return density.season_density(_cov(spark, sf), "temperature")
