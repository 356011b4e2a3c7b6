"""Filters and predicates (C1-C9). Written so Catalyst can push them to the
scan: comparisons on the raw column, no UDFs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.operators._util import col, join_scalar_keys, keys_list


def _date(d) -> dt.date:
    return d if isinstance(d, dt.date) else dt.date.fromisoformat(str(d))


def between_dates(df: DataFrame, start, end, ts_col: str = "ts") -> DataFrame:
    """Calendar date in [start, end], both ends included.

    Written as a half-open range on the raw timestamp so it becomes
    ``PushedFilters: [GreaterThanOrEqual(ts,..), LessThan(ts,..)]`` at the scan.
    """
    s, e = _date(start), _date(end)
    if s > e:
        raise ValueError(f"start {s} is after end {e}")
    lo = F.lit(dt.datetime.combine(s, dt.time())).cast("timestamp_ntz")
    hi = F.lit(dt.datetime.combine(e + dt.timedelta(days=1), dt.time())).cast("timestamp_ntz")
    c = col(ts_col)
    return df.where((c >= lo) & (c < hi))


def on_date(df: DataFrame, day, ts_col: str = "ts") -> DataFrame:
    """One calendar day."""
    return between_dates(df, day, day, ts_col)


def hour_between(df: DataFrame, h1: int, h2: int, ts_col: str = "hour") -> DataFrame:
    """Hour of the bucket in [h1, h2]."""
    return df.where(F.hour(col(ts_col)).between(h1, h2))


def year_and_month_between(df: DataFrame, year: int, m1: int, m2: int, ts_col: str = "ts") -> DataFrame:
    """C4: year equal, month in [m1, m2]; as a timestamp range for pushdown."""
    lo = dt.datetime(year, m1, 1)
    hi = dt.datetime(year + (m2 == 12), (m2 % 12) + 1, 1)
    c = col(ts_col)
    return df.where((c >= F.lit(lo).cast(df.schema[ts_col].dataType)) &
                    (c < F.lit(hi).cast(df.schema[ts_col].dataType)))


def mask_outside(df: DataFrame, value_col: str, lo: float, hi: float) -> DataFrame:
    """Values outside [lo, hi] become NULL; rows are kept."""
    v = col(value_col)
    return df.withColumn(value_col, F.when(v.between(lo, hi), v))


def zoom(df: DataFrame, start, end, ds_col: str = "ds") -> DataFrame:
    """Inclusive range on an already aggregated / forecast frame."""
    return df.where(col(ds_col).between(F.lit(_date(start)), F.lit(_date(end))))


def drop_incomplete(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop rows with a NULL in any of ``cols``."""
    return df.dropna(subset=cols)


def dedup_keep_last(df: DataFrame, key_cols: list[str], order_col: str, tie_cols: list[str] | None = None) -> DataFrame:
    """One row per key, the last in ``order_col`` order wins.

    An aggregate (``max_by`` of the row struct) rather than a window: it
    combines map-side, so a hot key is reduced before the shuffle instead of
    being sorted whole in one task."""
    other = [c for c in df.columns if c not in key_cols]
    ordering = F.struct(col(order_col), *[col(c) for c in (tie_cols or [])])
    packed = F.max_by(F.struct(*[col(c) for c in other]), ordering).alias("_last")
    return df.groupBy(*[col(c) for c in key_cols]).agg(packed).select(*key_cols, "_last.*")


def after_history(forecast: DataFrame, history: DataFrame, keys=None, ds_col: str = "ds") -> DataFrame:
    """Forecast rows dated after the last actual date of their series."""
    k = keys_list(keys)
    last = (history.groupBy(*k) if k else history).agg(F.max(ds_col).alias("_last_ds"))
    return join_scalar_keys(forecast, last, k).where(F.col(ds_col) > F.col("_last_ds")).drop("_last_ds")
