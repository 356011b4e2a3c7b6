"""Weather text and season features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weather text -> group, and the display order of the 11 groups
# (the last one, "Other", takes every unmapped or NULL text).
WEATHER_GROUP_ORDER = (
    "Clear", "Partly Cloudy", "Mostly Cloudy", "Overcast", "Drizzle",
    "Light Rain", "Rain", "Light Snow", "Flurries", "Breezy", "Other",
)
SUMMARY_TO_GROUP = {
    "Clear": "Clear", "Partly Cloudy": "Partly Cloudy", "Mostly Cloudy": "Mostly Cloudy",
    "Overcast": "Overcast", "Drizzle": "Drizzle", "Light Rain": "Light Rain",
    "Rain": "Rain", "Light Snow": "Light Snow", "Flurries": "Flurries", "Breezy": "Breezy",
}
OTHER_GROUP = "Other"

# Months of each season.
SEASONS = (("Winter", (12, 1, 2)), ("Spring", (3, 4, 5)), ("Summer", (6, 7, 8)))
DEFAULT_SEASON = "Autumn"
SEASON_ORDER = ("Winter", "Spring", "Summer", "Autumn")


def _c(c: str | Column) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def season(month: str | Column) -> Column:
    """12,1,2 Winter; 3-5 Spring; 6-8 Summer; else Autumn."""
    m = _c(month)
    expr = None
    for name, months in SEASONS:
        expr = (F.when(m.isin(*months), F.lit(name)) if expr is None
                else expr.when(m.isin(*months), F.lit(name)))
    return expr.otherwise(F.lit(DEFAULT_SEASON))


def weather_group(summary: str | Column) -> Column:
    """Map weather text to its group; unmapped or NULL -> Other.
    A literal map lookup: no join, no shuffle."""
    m = F.create_map(*[F.lit(x) for kv in SUMMARY_TO_GROUP.items() for x in kv])
    return F.coalesce(m[_c(summary)], F.lit(OTHER_GROUP))


def weather_group_ord(group: str | Column) -> Column:
    """Position of a group in the fixed display order (F3 sort key)."""
    m = F.create_map(*[x for i, g in enumerate(WEATHER_GROUP_ORDER) for x in (F.lit(g), F.lit(i))])
    return m[_c(group)]


def to_numeric(c: str | Column) -> Column:
    """Unparsable text -> NULL (ANSI mode would raise on a plain cast)."""
    return _c(c).cast("string").try_cast("double")
