"""Weekday x week grid of a daily series and its week labels.

Each output has a fixed size per year (7 x 53 cells, 53 weeks), so the
per-year windows here are bounded whatever the data volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions.calendar import week_dominant_month
from meterlake.operators._util import col, keys_list, null_safe_join

UNKNOWN = "Unknown"


def _years(daily: DataFrame, day_col: str, k: list[str]) -> DataFrame:
    return daily.select(*k, F.year(col(day_col)).alias("year")).distinct()


def week_weekday_grid(daily: DataFrame, value_col: str = "kwh", day_col: str = "day", keys=None) -> DataFrame:
    """E14 (+D4): mean daily value by (year, weekday 0=Mon, ISO week), every
    one of the 7 x 53 cells of each year (of each series, with ``keys``) present (NULL when empty)."""
    k = keys_list(keys)
    d = daily.select(*k, F.year(col(day_col)).alias("year"), F.weekday(col(day_col)).alias("weekday"),
                     F.weekofyear(col(day_col)).alias("week"), col(value_col).alias("_v"))
    cells = d.groupBy(*k, "year", "weekday", "week").agg(F.avg("_v").alias("mean_kwh"))
    grid = (_years(daily, day_col, k)
            .select(*k, "year", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("weekday"))
            .select(*k, "year", "weekday", F.explode(F.sequence(F.lit(1), F.lit(53))).alias("week")))
    return null_safe_join(grid, cells, [*k, "year", "weekday", "week"], "left")


def week_weekday_pivot_wide(grid: DataFrame, keys=None) -> DataFrame:
    """E14 at the edge: one row per (series, year, weekday), columns "1".."53"."""
    k = keys_list(keys)
    return (grid.groupBy(*k, "year", "weekday").pivot("week", list(range(1, 54)))
            .agg(F.first("mean_kwh")).orderBy(*k, "year", "weekday"))


def week_labels(daily: DataFrame, day_col: str = "day", rule: str = "reference", keys=None) -> DataFrame:
    """E17 (+D4) and B16: per (series, year, week 1..53) the month label of the
    week's first day with data ("Unknown" if none), and the display label that
    is shown only when it changes from the last shown one."""
    k = keys_list(keys)
    d = daily.select(*k, F.year(col(day_col)).alias("year"), F.weekofyear(col(day_col)).alias("week"), col(day_col).alias("_d"))
    d = d.withColumn("_label", week_dominant_month("year", "week", rule))
    first = d.groupBy(*k, "year", "week").agg(F.min_by("_label", "_d").alias("month_label"))
    grid = _years(daily, day_col, k).select(*k, "year", F.explode(F.sequence(F.lit(1), F.lit(53))).alias("week"))
    lab = null_safe_join(grid, first, [*k, "year", "week"], "left").withColumn(
        "month_label", F.coalesce("month_label", F.lit(UNKNOWN)))
    known = F.when(F.col("month_label") != UNKNOWN, F.col("month_label"))
    w = Window.partitionBy(*k, "year").orderBy("week").rowsBetween(Window.unboundedPreceding, -1)
    prev = F.last(known, ignorenulls=True).over(w)
    show = (F.col("month_label") != UNKNOWN) & (prev.isNull() | (prev != F.col("month_label")))
    return lab.withColumn("display_label", F.when(show, F.col("month_label")).otherwise(F.lit("")))
