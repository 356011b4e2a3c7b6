"""KPIs, totals, shares and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlake.operators._util import col, join_scalar_keys, keys_list


def _first_arg(value, at, largest: bool):
    """Bucket of the first extreme value: ordering by (-v, at) or (v, at),
    NULL values excluded (a NULL ordering is skipped by min_by)."""
    v = col(value)
    key = F.struct((-v) if largest else v, col(at))
    return F.min_by(col(at), F.when(v.isNotNull(), key))


def kpi_total_peak_mean(series: DataFrame, value_col: str, at_col: str, keys=None) -> DataFrame:
    """Total, peak, time of the first peak, mean and bucket count."""
    k = keys_list(keys)
    v = col(value_col)
    aggs = [
        F.sum(v).alias("total"),
        F.max(v).alias("peak"),
        _first_arg(value_col, at_col, True).alias("peak_at"),
        F.avg(v).alias("mean"),
        F.count(F.lit(1)).alias("n_buckets"),
    ]
    return series.groupBy(*k).agg(*aggs) if k else series.agg(*aggs)


def attach_kpis(series: DataFrame, value_col: str, at_col: str, keys, prefix: str = "") -> DataFrame:
    """E6 attached to every bucket row: the group's total, peak, first peak
    time, mean and bucket count, as windows over ``keys``. For calendar
    groups (e.g. a day of hourly buckets) the window size is fixed, so the
    series is computed once instead of aggregated and joined back."""
    w = Window.partitionBy(*keys_list(keys))
    v = col(value_col)
    return series.withColumns({
        f"{prefix}total": F.sum(v).over(w),
        f"{prefix}peak": F.max(v).over(w),
        f"{prefix}peak_at": _first_arg(value_col, at_col, True).over(w),
        f"{prefix}mean": F.avg(v).over(w),
        f"{prefix}buckets": F.count(F.lit(1)).over(w),
    })


def peak_and_min_points(series: DataFrame, value_col: str, at_col: str, keys=None) -> DataFrame:
    """First argmax and first argmin with their values."""
    k = keys_list(keys)
    v = col(value_col)
    aggs = [
        _first_arg(value_col, at_col, True).alias("peak_at"),
        F.max(v).alias("peak"),
        _first_arg(value_col, at_col, False).alias("min_at"),
        F.min(v).alias("min"),
    ]
    return series.groupBy(*k).agg(*aggs) if k else series.agg(*aggs)


def site_summary(df: DataFrame, use_col: str = "use_kw", gen_col: str = "gen_kw", keys=None) -> DataFrame:
    """Sums of use, generation and net, and self-sufficiency in percent
    (0 when total use is not positive). A missing side of a row counts as 0,
    so net is use minus generation whether or not they stand on the same rows.
    One aggregate pass."""
    k = keys_list(keys)
    u, g = col(use_col), col(gen_col)
    aggs = [
        F.coalesce(F.sum(u), F.lit(0.0)).alias("total_use"),
        F.coalesce(F.sum(g), F.lit(0.0)).alias("total_gen"),
        F.coalesce(F.sum(F.coalesce(u, F.lit(0.0)) - F.coalesce(g, F.lit(0.0))), F.lit(0.0)).alias("total_net"),
    ]
    base = df.groupBy(*k).agg(*aggs) if k else df.agg(*aggs)
    return base.withColumn(
        "self_sufficiency_pct",
        F.when(F.col("total_use") > 0, F.col("total_gen") / F.col("total_use") * 100).otherwise(F.lit(0.0)))


def device_totals(df: DataFrame, device_col: str = "device", value_col: str = "kw", keys=None,
                  samples_per_hour: int = 60) -> DataFrame:
    """Sum per device (raw kW-minute sum as the source labels it, and kWh)."""
    k = keys_list(keys)
    return (df.groupBy(*k, device_col)
            .agg(F.coalesce(F.sum(col(value_col)), F.lit(0.0)).alias("total"))
            .withColumn("kwh", F.col("total") / samples_per_hour))


def device_totals_wide(df: DataFrame, device_cols: list[str], samples_per_hour: int = 60) -> DataFrame:
    """E9 on the wide layout: ONE aggregate of every device column, then
    unpivoted to (device, total, kwh), largest first."""
    present = [c for c in device_cols if c in df.columns]
    sums = df.agg(*[F.coalesce(F.sum(col(c)), F.lit(0.0)).alias(c) for c in present])
    long = sums.unpivot([], [col(c) for c in present], "device", "total")
    return long.withColumn("kwh", F.col("total") / samples_per_hour).orderBy(F.desc("total"), "device")


def share_of_total(totals: DataFrame, value_col: str = "total", keys=None, out_col: str = "share_pct",
                   digits: int = 1) -> DataFrame:
    """100 * x / sum(x), rounded half-even to ``digits``.

    The denominator is a per-key aggregate joined back (a scalar subquery
    without keys), not an unpartitioned window."""
    k = keys_list(keys)
    tot = (totals.groupBy(*k) if k else totals).agg(F.sum(col(value_col)).alias("_sum"))
    out = join_scalar_keys(totals, tot, k)
    return out.withColumn(out_col, F.bround(col(value_col) / F.col("_sum") * 100, digits)).drop("_sum")


def _rank(totals: DataFrame, value_col: str, name_col: str, keys: list[str]):
    w = Window.partitionBy(*keys).orderBy(F.desc(value_col), F.asc(name_col)) if keys else \
        Window.orderBy(F.desc(value_col), F.asc(name_col))
    return F.row_number().over(w)


def top_k(totals: DataFrame, k: int = 5, value_col: str = "total", name_col: str = "device",
          keys=None) -> DataFrame:
    """the k largest, ties by name. Without keys this is a TakeOrdered
    (each task keeps k rows); with keys a per-key row number."""
    ks = keys_list(keys)
    if not ks:
        return totals.orderBy(F.desc(value_col), F.asc(name_col)).limit(k)
    return totals.withColumn("_rn", _rank(totals, value_col, name_col, ks)).where(F.col("_rn") <= k).drop("_rn")


def top_k_plus_other(shares: DataFrame, k: int = 5, share_col: str = "share_pct", name_col: str = "device",
                     keys=None, order_col: str = "total", other: str = "Other") -> DataFrame:
    """the top k shares kept, the rest summed into one ``Other`` row (the
    sum of the already rounded shares); ``Other`` only when there is a rest.

    The input is one row per (key, device): its size is the number of
    devices, not of readings."""
    ks = keys_list(keys)
    if ks:
        ranked = shares.withColumn("_rn", _rank(shares, order_col, name_col, ks))
    else:
        # No keys: the top k come from a TakeOrdered (k rows, a proven bound)
        # joined back by name, instead of ranking every row in one window.
        top = (shares.orderBy(F.desc(order_col), F.asc(name_col)).limit(k)
               .select(col(name_col).alias("_top"), col(order_col).alias("_v")))
        top = top.withColumn("_rn", F.row_number().over(Window.orderBy(F.desc("_v"), F.asc("_top"))))
        ranked = shares.join(F.broadcast(top.select("_top", "_rn")), col(name_col) == F.col("_top"), "left") \
            .withColumn("_rn", F.coalesce(F.col("_rn"), F.lit(k + 1))).drop("_top")
    label = F.when(F.col("_rn") <= k, col(name_col)).otherwise(F.lit(other))
    return (ranked.groupBy(*ks, label.alias(name_col))
            .agg(F.sum(share_col).alias(share_col), F.min("_rn").alias("rank")))


def ordered_groups(df: DataFrame, ord_col: str) -> DataFrame:
    """sort by a categorical position, not by text."""
    return df.orderBy(ord_col)


def sort_series(df: DataFrame, ds_col: str = "ds", keys=None) -> DataFrame:
    """ascending by date (per key) at output time."""
    return df.orderBy(*keys_list(keys), ds_col)


def missing_report(completed: DataFrame, keys=None, ds_col: str = "ds", value_col: str = "y",
                   warn_share: float = 0.10) -> DataFrame:
    """Missing-day count, share, sorted list (``dd/MM/yyyy``) and a flag
    when more than ``warn_share`` of the range is missing.

    The list per key holds at most one entry per calendar bucket of the
    requested range: its size is bounded by the range, not by the data."""
    k = keys_list(keys)
    miss = F.col(value_col).isNull()
    aggs = [
        F.count(F.lit(1)).alias("n_days"),
        F.count_if(miss).alias("n_missing"),
        F.array_sort(F.collect_list(F.when(miss, F.col(ds_col)))).alias("_m"),
    ]
    base = completed.groupBy(*k).agg(*aggs) if k else completed.agg(*aggs)
    return base.select(
        *k, "n_days", "n_missing",
        (F.col("n_missing") / F.col("n_days") * 100).alias("missing_pct"),
        F.array_join(F.transform("_m", lambda d: F.date_format(d, "dd/MM/yyyy")), ", ").alias("missing_dates"),
        (F.col("n_missing") > F.col("n_days") * warn_share).alias("too_many_missing"),
    )


def value_range(series: DataFrame, value_col: str, keys=None) -> DataFrame:
    """Min and max (0 and 1 when there is nothing)."""
    k = keys_list(keys)
    aggs = [F.coalesce(F.min(value_col), F.lit(0.0)).alias("min_value"),
            F.coalesce(F.max(value_col), F.lit(1.0)).alias("max_value")]
    return series.groupBy(*k).agg(*aggs) if k else series.agg(*aggs)
