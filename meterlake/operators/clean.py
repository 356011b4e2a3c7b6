"""Cleaning (B5, B6, B7).

B5 needs "the next valid value in time order", a fill across the whole
series. A window over the whole series would put it in one task; an ordered
scan (``scan.ordered_scan``) runs through ranges of the order instead, and only one
state a range goes from range to range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions.weather import to_numeric
from meterlake.operators._util import col, join_scalar_keys, keys_list
from meterlake.operators.scan import ordered_scan

# Fixed value: the junk literal found in the cloudCover column.
JUNK_LITERAL = "cloudCover"

# The temperature columns converted together, and the rule.
FAHRENHEIT_COLUMNS = ("temperature", "apparentTemperature", "dewPoint")
FAHRENHEIT_THRESHOLD = 80.0


def valid_reading(value_col: str, junk: str = JUNK_LITERAL) -> Column:
    """A non-junk reading (NULL included) in a struct, so "no value yet" (NULL struct) differs from "the reading is NULL"."""
    raw = col(value_col)
    return F.when(raw.isNull() | (raw != F.lit(junk)), F.struct(raw.alias("v")))


def filled_number(reading: Column) -> Column:
    return to_numeric(reading.getField("v"))


def clean_backfill(df: DataFrame, value_col: str, order_cols: list[str], keys=None,
                   junk: str = JUNK_LITERAL, out_col: str | None = None) -> DataFrame:
    """Replace the junk literal by the next valid value in time order and
    cast to double. A trailing junk run has no successor and becomes NULL.

    The next valid value is the last one of a scan that runs backwards; rows without a time stand first in time. Rows that
    tie in ``order_cols`` stand in the order of a hash of the row."""
    order = [col(c).desc_nulls_last() for c in order_cols]
    d = ordered_scan(df, order, keys_list(keys), last_valid={"_next": valid_reading(value_col, junk)})
    return d.withColumn(out_col or value_col, filled_number(F.col("_next"))).drop("_next")


def fahrenheit_to_celsius(df: DataFrame, keys=None, threshold: float = FAHRENHEIT_THRESHOLD,
                          cols=FAHRENHEIT_COLUMNS) -> DataFrame:
    """When max(temperature) > threshold, convert the present temperature
    columns with (x - 32) * 5 / 9. The max is one scalar subquery (per key: a
    joined aggregate)."""
    if "temperature" not in df.columns:
        return df
    k = keys_list(keys)
    mx = (df.groupBy(*k) if k else df).agg(F.max("temperature").alias("_tmax"))
    d = join_scalar_keys(df, mx, k)
    present = [c for c in cols if c in df.columns]
    conv = {c: F.when(F.col("_tmax") > threshold, (col(c) - 32) * 5.0 / 9.0).otherwise(col(c))
            for c in present}
    return d.withColumns(conv).drop("_tmax")


def to_numeric_columns(df: DataFrame, cols) -> DataFrame:
    """Coerce the present columns to double, unparsable text -> NULL."""
    present = [c for c in cols if c in df.columns]
    return df.withColumns({c: to_numeric(c) for c in present})
