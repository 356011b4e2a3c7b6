"""Calendar features and labels.

Every function returns a Column; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def calendar_features(df: DataFrame, ts_col: str = "ts") -> DataFrame:
    """B1: year, month, day, day name, ISO week, hour, minute, date and
    day of week (Monday = 0)."""
    ts = F.col(ts_col)
    return df.withColumns({
        "year": F.year(ts),
        "month": F.month(ts),
        "day": F.dayofmonth(ts),
        "day_name": F.date_format(ts, "EEEE"),
        "weekofyear": F.weekofyear(ts),
        "hour": F.hour(ts),
        "minute": F.minute(ts),
        "date": F.to_date(ts),
        "day_of_week": F.weekday(ts),
    })


def weekend(ts: str | Column) -> Column:
    """B2: Saturday or Sunday."""
    return F.weekday(_c(ts)).isin(5, 6)


def year_month(ts: str | Column) -> Column:
    """``YYYY-MM`` text of the period."""
    return F.date_format(_c(ts), "yyyy-MM")


# The label formats the pages print.
DATE_LABEL = "dd/MM/yyyy"
DAY_MONTH_LABEL = "dd/MM"
HOUR_LABEL = "HH:mm"
MONTH_NAME = "MMMM"


def date_label(c: str | Column, fmt: str = DATE_LABEL) -> Column:
    """``dd/MM/yyyy`` and the other fixed label formats."""
    return F.date_format(_c(c), fmt)


def week_monday(year: str | Column, week: str | Column, rule: str = "reference") -> Column:
    """Monday of week ``week`` of ``year``.

    ``rule="reference"``: ``%W`` numbering, week 1 starts on the first Monday of
    the year (days before it are week 0). ``rule="iso"``: ISO 8601 weeks, week 1
    holds 4 January.
    """
    y, w = _c(year), _c(week)
    if rule == "reference":
        first_monday = F.next_day(F.date_sub(F.make_date(y, F.lit(1), F.lit(1)), 1), "Mon")
        return F.date_add(first_monday, (w - 1) * 7)
    if rule == "iso":
        jan4 = F.make_date(y, F.lit(1), F.lit(4))
        return F.date_add(F.date_sub(jan4, F.weekday(jan4)), (w - 1) * 7)
    raise ValueError(f"unknown week rule {rule!r}")


def week_dominant_month(year: str | Column, week: str | Column, rule: str = "reference") -> Column:
    """English name of the month holding most of the week's 7 days.

    Seven days span at most two months, so the majority month is the month of
    the fourth day (Thursday)."""
    return F.date_format(F.date_add(week_monday(year, week, rule), 3), MONTH_NAME)


def week_weekday_date(year: str | Column, week: str | Column, weekday: str | Column,
                      rule: str = "reference") -> Column:
    """The date of (year, week, weekday 0=Mon) as ``dd/MM/yyyy``, or
    ``Unknown`` when it cannot be formed."""
    d = F.date_add(week_monday(year, week, rule), _c(weekday))
    return F.coalesce(F.date_format(d, DATE_LABEL), F.lit("Unknown"))
