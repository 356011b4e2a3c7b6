"""Resampling with gap fill (E1-E5), calendar completion (D2) and alignment
(D1, D6).

Plan shape for a sum roll-up: partial hash aggregate on (keys, bucket) before
the shuffle, final aggregate after it. Gaps are filled from the aggregate
itself: every bucket is followed by the empty buckets up to its key's next
one (``lead``), so the raw rows are read and shuffled once and no calendar is
joined. A NULL key is a key like any other; rows without a time have no bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions.energy import SAMPLES_PER_HOUR
from meterlake.operators._util import col, keys_list, null_safe_join

STEP = {"minute": "INTERVAL 1 MINUTE", "hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY",
        "month": "INTERVAL 1 MONTH"}
BUCKET_NAME = {"minute": "minute", "hour": "hour", "day": "day", "month": "month"}


def bucket(ts: Column, freq: str) -> Column:
    """Start of the bucket holding ``ts``. Minute/hour buckets stay
    TIMESTAMP_NTZ (``date_trunc`` goes through the session zone, set to UTC);
    day and month buckets are DATE."""
    if freq in ("minute", "hour"):
        return F.date_trunc(freq, ts).cast("timestamp_ntz")
    if freq == "day":
        return F.to_date(ts)
    if freq == "month":
        return F.trunc(F.to_date(ts), "month")
    raise ValueError(f"unknown frequency {freq!r}")


def _span_calendar(agg: DataFrame, keys: list[str], bcol: str, freq: str,
                   start=None, end=None) -> DataFrame:
    """Every bucket from first to last (per key), or over an explicit range."""
    step = F.expr(STEP[freq])
    if start is None or end is None:
        span = (agg.groupBy(*keys) if keys else agg).agg(
            F.min(bcol).alias("_lo"), F.max(bcol).alias("_hi"))
        if start is not None:
            span = span.withColumn("_lo", bucket(F.lit(start).cast("timestamp_ntz"), freq))
        if end is not None:
            span = span.withColumn("_hi", bucket(F.lit(end).cast("timestamp_ntz"), freq))
    else:
        lo = bucket(F.lit(start).cast("timestamp_ntz"), freq)
        hi = bucket(F.lit(end).cast("timestamp_ntz"), freq)
        base = agg.select(*keys).distinct() if keys else agg.sparkSession.range(1).select()
        span = base.select(*keys, lo.alias("_lo"), hi.alias("_hi"))
    return span.select(*keys, F.explode(F.sequence("_lo", "_hi", step)).alias(bcol))


def _before(b: Column, freq: str) -> Column:
    """The bucket before ``b``."""
    if freq == "day":
        return F.date_sub(b, 1)
    if freq == "month":
        return F.add_months(b, -1)
    return b - F.expr(STEP[freq])


def _fill(agg: DataFrame, keys: list[str], bcol: str, freq: str, names: list[str], fill: float | None,
          start=None, end=None) -> DataFrame:
    """``agg`` with every bucket between a key's first and last one (or
    ``start`` / ``end``); values of the new buckets are ``fill``."""
    w = Window.partitionBy(*keys).orderBy(bcol)
    lo, hi = F.col(bcol), F.col(bcol)
    if start is not None:
        first = bucket(F.lit(start).cast("timestamp_ntz"), freq)
        lo = F.when(F.lag(bcol).over(w).isNull(), F.least(first, F.col(bcol))).otherwise(F.col(bcol))
    if end is not None:
        hi = F.greatest(bucket(F.lit(end).cast("timestamp_ntz"), freq), F.col(bcol))
    # Everything after the aggregate is one row per key and bucket.
    spans = agg.select(*keys, *[col(n) for n in names], F.col(bcol).alias("_own"), lo.alias("_lo"),
                       F.coalesce(_before(F.lead(bcol).over(w), freq), hi).alias("_hi"))
    every = spans.select("*", F.explode(F.sequence("_lo", "_hi", F.expr(STEP[freq]))).alias(bcol))
    own = F.col(bcol) == F.col("_own")
    empty = F.lit(None) if fill is None else F.lit(fill)
    value = [(F.when(own, col(n)).otherwise(empty) if fill is None
              else F.coalesce(F.when(own, col(n)), empty)).alias(n) for n in names]
    return every.select(*keys, bcol, *value)


def resample(df: DataFrame, value_cols: Sequence[str] | str, freq: str = "day", how: str = "sum",
             keys=None, ts_col: str = "ts", gap_fill: str | None = "zero", start=None, end=None,
             divisor: float | None = None, out_names: Sequence[str] | None = None,
             bucket_col: str | None = None) -> DataFrame:
    """Roll readings up to ``freq`` buckets per key.

    ``how="sum"`` adds readings (divided by ``divisor``); ``how="mean"`` averages.
    ``gap_fill="zero"`` gives empty buckets inside the span 0 (a pandas sum over
    an empty bin), ``"null"`` leaves them NULL, ``None`` returns observed
    buckets only. ``start``/``end`` widen or narrow the calendar (C1/D2).
    """
    k = keys_list(keys)
    vals = [value_cols] if isinstance(value_cols, str) else list(value_cols)
    names = list(out_names) if out_names else vals
    bcol = bucket_col or BUCKET_NAME[freq]
    b = bucket(col(ts_col), freq).alias(bcol)
    # The range is one of the raw time, so that it reaches the scan whatever the bucket.
    if start is not None:
        df = df.where(col(ts_col) >= bucket(F.lit(start).cast("timestamp_ntz"), freq).cast("timestamp_ntz"))
    if end is not None:
        df = df.where(col(ts_col) < bucket(F.lit(end).cast("timestamp_ntz"), freq).cast("timestamp_ntz") + F.expr(f"interval 1 {freq}"))
    src = df.select(*k, b, *[col(v) for v in vals])
    if how == "sum":
        d = 1.0 if divisor is None else float(divisor)
        aggs = [(F.sum(col(v)) / F.lit(d)).alias(n) for v, n in zip(vals, names)]
    elif how == "mean":
        aggs = [F.avg(col(v)).alias(n) for v, n in zip(vals, names)]
    else:
        raise ValueError(how)
    agg = src.groupBy(*k, bcol).agg(*aggs)
    if gap_fill is None:
        return agg
    agg = agg.where(F.col(bcol).isNotNull())
    zero = gap_fill == "zero" and how == "sum"
    if k or start is None or end is None:
        return _fill(agg, k, bcol, freq, names, 0.0 if zero else None, start, end)
    # One series over a stated range: the range alone gives the calendar, also where there are no readings.
    out = _span_calendar(agg, k, bcol, freq, start, end).join(agg, on=bcol, how="left")
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(0.0)) for n in names}) if zero else out


def energy(df: DataFrame, value_cols, freq: str, keys=None, ts_col: str = "ts",
           gap_fill: str | None = "zero", start=None, end=None, out_names=None,
           samples_per_hour: int = SAMPLES_PER_HOUR, label: str = "start") -> DataFrame:
    """kWh per bucket = sum of kW readings / samples per hour.

    Monthly buckets are labelled by month end (``label="end"``) or start.
    A5: a missing or non-numeric value column gives an empty frame, no error."""
    from pyspark.sql import types as T
    from meterlake.operators.ingest import guarded
    vals = [value_cols] if isinstance(value_cols, str) else list(value_cols)
    names = list(out_names) if out_names else vals
    k = keys_list(keys)
    btype = T.TimestampNTZType() if freq in ("minute", "hour") else T.DateType()
    key_fields = [f for f in df.schema.fields if f.name in k]
    empty = guarded(df, vals, T.StructType(
        key_fields + [T.StructField(BUCKET_NAME[freq], btype)] +
        [T.StructField(n, T.DoubleType()) for n in names]))
    if empty is not None:
        return empty
    out = resample(df, value_cols, freq, "sum", keys, ts_col, gap_fill, start, end,
                   samples_per_hour, out_names)
    if freq == "month" and label == "end":
        out = out.withColumn("month", F.last_day("month"))
    return out


def daily_energy(df, value_cols="kw", keys=None, **kw):
    """Daily kWh, empty days inside the span give 0."""
    return energy(df, value_cols, "day", keys, **kw)


def hourly_energy(df, value_cols="kw", keys=None, **kw):
    """Hourly kWh, empty hours inside the span give 0."""
    return energy(df, value_cols, "hour", keys, **kw)


def monthly_energy(df, value_cols="kw", keys=None, label: str = "end", **kw):
    """Monthly kWh, labelled by month end by default."""
    return energy(df, value_cols, "month", keys, label=label, **kw)


def daily_mean(df: DataFrame, value_cols: Sequence[str] | None = None, keys=None, ts_col: str = "ts",
               gap_fill: str | None = "null") -> DataFrame:
    """Mean of every numeric column per day; an empty day is NULL."""
    from pyspark.sql import types as T
    k = keys_list(keys)
    vals = list(value_cols) if value_cols else [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in k and f.name != ts_col]
    return resample(df, vals, "day", "mean", k, ts_col, gap_fill)


def monthly_mean(df: DataFrame, value_cols: Sequence[str], keys=None, ts_col: str = "ts") -> DataFrame:
    """E5: mean by month number 1-12, pooling years."""
    k = keys_list(keys)
    return (df.groupBy(*k, F.month(col(ts_col)).alias("month"))
            .agg(*[F.avg(col(v)).alias(v) for v in value_cols]))


def align_use_gen(df: DataFrame, use_col: str = "use_kw", gen_col: str = "gen_kw",
                  freq: str = "hour", keys=None, ts_col: str = "ts",
                  samples_per_hour: int = SAMPLES_PER_HOUR) -> DataFrame:
    """D1 (+B3): use and generation per bucket side by side, missing = 0, and
    their difference. Both come from one table, so one aggregate does it; no
    join of two roll-ups."""
    out = energy(df, [use_col, gen_col], freq, keys, ts_col, "zero",
                 out_names=["use_kwh", "gen_kwh"], samples_per_hour=samples_per_hour)
    return out.withColumn("net_kwh", F.col("use_kwh") - F.col("gen_kwh"))


def align_two(left: DataFrame, right: DataFrame, on: list[str], left_val: str, right_val: str) -> DataFrame:
    """D1 for two separate tables: full outer join on the bucket, missing = 0."""
    j = null_safe_join(left, right, on, "full")
    return j.withColumns({left_val: F.coalesce(F.col(left_val), F.lit(0.0)),
                          right_val: F.coalesce(F.col(right_val), F.lit(0.0))})


def complete_calendar(series: DataFrame, start, end, keys=None, ds_col: str = "ds",
                      value_col: str = "y", freq: str = "day") -> DataFrame:
    """Left join every bucket of [start, end] (per key) to the series; a
    bucket with no row gets NULL."""
    k = keys_list(keys)
    cal = _span_calendar(series.withColumnRenamed(ds_col, "_b"), k, "_b", freq, start, end)
    cal = cal.withColumnRenamed("_b", ds_col)
    return null_safe_join(cal, series.select(*k, ds_col, value_col), [*k, ds_col], "left")


def align_devices_daily(df: DataFrame, device_col: str = "device", value_col: str = "kw",
                        devices: Sequence[str] | None = None, ts_col: str = "ts",
                        samples_per_hour: int = SAMPLES_PER_HOUR) -> DataFrame:
    """N device daily series in one frame, one column per device.

    One aggregate + pivot instead of n joins. A device's zero-filled days
    (E1) stay in; days outside a device's own span are NULL."""
    daily = daily_energy(df, value_col, keys=[device_col], ts_col=ts_col,
                         samples_per_hour=samples_per_hour, out_names=["kwh"])
    piv = daily.groupBy("day").pivot(device_col, list(devices) if devices else None)
    return piv.agg(F.first("kwh"))
